"""Secret scan: character Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio.

Candidates are maximal runs of at least ``MIN_LENGTH`` letters, digits and ``+/_-=`` (ASCII).  There is a first-order Markov
model, with add-``SMOOTHING`` smoothing, for each family of random strings (hexadecimal, base 32, letters and digits, base 64) and one
for ordinary identifiers and words; all are trained from labelled samples.  A candidate's ratio is its greatest
log-likelihood under a family minus the one under the ordinary model; it is a secret if the ratio is at least ``MIN_RATIO``, and
at least ``MIN_PER_CHAR`` per character.  Names and paths may be joined to a secret by one of ``+/_-=``, so that in a run that has some, not the run but
its stretches from one of these to another are candidates: the one that passes by the greatest margin is a secret, and what is left on
both sides is searched again.  Shorter strings than ``MIN_LENGTH`` aren't candidates, as their ratios say too little.

Cases: null and empty texts have no secrets, and an empty table has none.  Texts are scanned whole; a run of any length is one candidate, in time
linear in it for each secret found.  Of families with the same ratio the first counts, of stretches with the same margin the one that ends first.  Rows stand for
themselves: repeated rows give repeated findings, and a null ``doc_id`` is carried along.  Offsets are code points, the end
exclusive; the string itself isn't returned.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _flat
from ._spark import table

MIN_LENGTH = 16
MIN_RATIO = 10.0
MIN_PER_CHAR = 0.4
SMOOTHING = 1.0
SAMPLES = 4000
ORDINARY = "ordinary"

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALPHABET = _LOWER + _UPPER + _DIGITS + "+/_-="
_INDEX = np.full(256, -1, np.int64)
_INDEX[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_INSIDE = _INDEX >= 0
_JOINER = np.isin(np.arange(256), [ord(c) for c in "+/_-="])
FAMILIES = {
    "hex": _DIGITS + "abcdef",
    "upper_hex": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "lower_alnum": _LOWER + _DIGITS,
    "alnum": _LOWER + _UPPER + _DIGITS,
    "base64": _LOWER + _UPPER + _DIGITS + "+/_-",
}
_TOPICS = (
    "about above account action active address after agent alert align amount analysis animal answer archive array article asset async attribute audio average background backup balance bank base batch before binary block board body "
    "boolean border bottom boundary branch browser buffer build button cache calendar call cancel capital capture card catalog category center chain change channel character check child city class clean client clock close cloud cluster "
    "code collection color column command comment common company compare component compute condition config connect console constant contact container content context control convert cookie copy core corner count country course create "
    "credit current custom customer daily data database date default define delete delivery department depth design detail device dialog direct disk display distance document domain double download draft driver duration dynamic edge "
    "editor element email empty enable encode energy engine entity entry environment error event example exception execute export expression extension external factory feature field figure file filter final find first flag float folder "
    "font footer force form format forward found frame function future gallery general generate global graph group handler hash header health height hidden history holder home host hour icon image import include index info initial inner "
    "input insert instance integer interface internal interval invoice item iterator job journal key kernel keyboard label language large last layer layout leader left length level library license light limit line link list listener load "
    "local location lock log login long machine main manager map margin market master match matrix maximum measure media member memory menu merge message meta method metric middle minimum minute mobile mode model module monitor month "
    "mount move multiple name native network next node normal notification null number object offset online open operation option order origin other output owner package page panel parameter parent parse part partition password path "
    "pattern payment people percent period permission person phone picture pixel place plan platform player plugin point policy pool port position post power prefix preview price primary print priority private process product profile "
    "program progress project property protocol provider proxy public publish query queue quick random range rate reader record reference region register release remote remove render replace report request reset resource response result "
    "return review right role root route row rule runtime sample save scale schedule schema scope screen script scroll search second section secure select sender sequence series server service session setting shadow shape share shell "
    "short signal simple single size slide small socket sort source space special speed split square stack stage standard start state static station status step stock storage store stream string struct student style subject submit success "
    "summary support switch symbol sync system table target task team template terminal test text theme thread throw ticket time title token tool top total trace track traffic transfer transform transition tree trigger type unique unit "
    "update upload user utility valid value variable vector vendor version video view virtual visible visit volume warning watch water weather week weight width window word worker world write year zone "
    "abteilung anwendung arbeit bedeutung beispiel bericht bestellung beziehung darstellung entwicklung erfahrung gesellschaft geschichte gesundheit leistung lieferung möglichkeit regierung richtung sicherheit verbindung verfahren "
    "verwaltung wirtschaft wissenschaft zusammenhang zeitschrift unterricht zeichen schlecht zwischen achtung appartement beaucoup bienvenue bureau changement chapeau chaussure connaissance conseil developpement eau enseignement entreprise "
    "environnement etablissement evenement fonctionnement gouvernement information jeunesse maintenant monsieur nouveau oiseau quelque question restaurant souvent travail vaisseau acontecimiento actividad ayuntamiento ciudad conocimiento "
    "desarrollo educacion empresa entonces gobierno investigacion llegada movimiento nacimiento organizacion pensamiento quehacer siempre sociedad trabajo universidad verdadero"
).split()


def samples(n: int = SAMPLES, seed: int = 4) -> list[tuple[str, str]]:
    """(text, label): n strings of each random family, and 3 n ordinary ones: identifiers in the usual styles, words, paths, numbers and dates."""
    rng = np.random.default_rng(seed)
    out = []
    for family, alphabet in FAMILIES.items():
        letters = np.array(list(alphabet))
        out += [("".join(rng.choice(letters, k)), family) for k in rng.choice([16, 20, 24, 32, 40, 64], n)]

    def ordinary(style: int) -> str:
        words = [_TOPICS[i] for i in rng.integers(0, len(_TOPICS), rng.integers(2, 6))]
        number = str(rng.integers(0, 10 ** int(rng.integers(1, 5))))
        match style:
            case 0:
                return words[0] + "".join(w.capitalize() for w in words[1:])
            case 1:
                return "".join(w.capitalize() for w in words)
            case 2:
                return "_".join(words)
            case 3:
                return "-".join(words)
            case 4:
                return "_".join(words).upper()
            case 5:
                return "/".join(["", *words])
            case 6:
                return "_".join(words) + "_" + number
            case 7:
                return "".join(words)
            case 8:
                return "".join(w.capitalize() for w in words) + number
            case 9:
                return "".join(rng.choice(list(_DIGITS), rng.integers(10, 24)))
            case 10:
                y, m, d = rng.integers(1990, 2031), rng.integers(1, 13), rng.integers(1, 29)
                return f"{y}-{m:02}-{d:02}-" + words[0] if rng.random() < 0.5 else f"{y}/{m:02}/{d:02}/" + "-".join(words)
            case 11:
                return "".join(words).upper()
            case _:
                return rng.choice(list("-=_/+")) * int(rng.integers(8, 30)) + words[0]

    return out + [(ordinary(i % 13), ORDINARY) for i in range(3 * n)]


class Model:
    """Log-likelihood ratios of character pairs, [family, alphabet + 1, alphabet]; the last row is for a string's first character."""

    def __init__(self, labelled: list[tuple[str, str]], smoothing: float = SMOOTHING):
        m = len(_ALPHABET)
        logs = {}
        for label in dict.fromkeys(x for _, x in labelled):
            counts = np.full((m + 1, m), smoothing)
            for text, x in labelled:
                if x == label:
                    at = _INDEX[np.frombuffer(text.encode(), np.uint8)]
                    at = at[at >= 0]
                    np.add.at(counts, (np.concatenate([[m], at[:-1]]), at), 1)
            logs[label] = np.log(counts / counts.sum(axis=1, keepdims=True))
        ordinary = logs.pop(ORDINARY)
        self.families = list(logs)
        self.ratios = np.stack([x - ordinary for x in logs.values()])

    def score(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest ratio of each run of bytes, and its family."""
        starts = np.cumsum(length) - length
        at = np.arange(length.sum()) + np.repeat(begin - starts, length)
        own = _INDEX[data[at]]
        before = np.concatenate([[0], own[:-1]])
        before[starts] = len(_ALPHABET)
        totals = np.stack([np.add.reduceat(r[before, own], starts) for r in self.ratios])
        return totals.max(axis=0), totals.argmax(axis=0)

    def stretch(self, run: np.ndarray, min_length: int, min_ratio: float, min_per_char: float) -> tuple[int, int, float, int] | None:
        """(start, end, ratio, family) of the stretch between joiners of a run of bytes that passes by the greatest margin per family, or None."""
        n, own, joiner = len(run), _INDEX[run], _JOINER[run]
        may_start = np.concatenate([[True], joiner[:-1]])
        may_end = np.concatenate([[False], joiner[1:], [True]])
        at = np.arange(n)
        # from this length on, a ratio that is enough per character is enough in all
        enough = max(min_length, math.ceil(min_ratio / min_per_char) if min_per_char > 0 else min_length)
        best = None
        for family, ratios in enumerate(self.ratios):
            # a stretch's margin is upto[end] + opening[start]
            sums = np.concatenate([[0.0], np.cumsum(np.concatenate([[0.0], ratios[own[:-1], own[1:]]]))])
            upto = sums - min_per_char * np.arange(n + 1)
            opening = np.where(may_start, ratios[len(_ALPHABET), own] - sums[1:] + min_per_char * at, -np.inf)
            found = []
            if n >= enough:
                first = np.maximum.accumulate(opening[: n - enough + 1])
                margin = np.where(may_end[enough:], upto[enough:] + first, -np.inf)
                end = int(margin.argmax())
                found.append((float(margin[end]), int(opening[: end + 1].argmax()), end + enough))
            for length in range(min_length, min(enough, n + 1)):
                margin = np.where(may_end[length:], upto[length:] + opening[: n - length + 1], -np.inf)
                start = int(margin.argmax())
                found.append((float(margin[start]), start, start + length))
            for margin, start, end in found:
                ratio = margin + min_per_char * (end - start)
                if margin >= 0 and ratio >= min_ratio and (best is None or margin > best[0]):
                    best = (margin, start, end, ratio, family)
        return best and best[1:]

    def stretches(self, run: np.ndarray, *limits) -> Iterator[tuple[int, int, float, int]]:
        """All of a run's stretches that pass, in order and without overlaps."""
        todo, found = [(0, len(run))], []
        while todo:
            low, high = todo.pop()
            if high - low < limits[0] or not (best := self.stretch(run[low:high], *limits)):
                continue
            start, end = low + best[0], low + best[1]
            found.append((start, end, *best[2:]))
            # the joiner beside a stretch is no part of what is left
            todo += [(low, start - 1), (end + 1, high)]
        return iter(sorted(found))

    def scan(self, texts: pa.Array, min_length: int = MIN_LENGTH, min_ratio: float = MIN_RATIO, min_per_char: float = MIN_PER_CHAR) -> list[tuple[int, int, int, str, float]]:
        """(text's place, start, end, family, ratio) of each secret."""
        out = []
        for low, high in _flat.slices(texts):
            data, ends = _flat.utf8(texts.slice(low, high - low))
            inside = _INSIDE[data]
            edge = ends[(ends > 0) & (ends < len(data))]  # a run doesn't cross from one text into the next
            joined = inside[1:] & inside[:-1]
            joined[edge - 1] = False
            begin = np.flatnonzero(inside & ~np.concatenate([[False], joined])[: len(inside)])
            stop = np.flatnonzero(inside & ~np.concatenate([joined, [False]])[: len(inside)]) + 1
            long = stop - begin >= min_length
            begin, length = begin[long], (stop - begin)[long]
            if len(begin) == 0:
                continue
            ratio, family = self.score(data, begin, length)
            passed = (ratio >= min_ratio) & (ratio >= min_per_char * length)
            joiners = np.concatenate([[0], np.cumsum(_JOINER[data])])
            parts = joiners[begin + length] > joiners[begin]
            for k in np.flatnonzero(passed | parts).tolist():
                a = int(begin[k])
                doc = int(np.searchsorted(ends, a, "right")) - 1
                found = self.stretches(data[a : a + length[k]], min_length, min_ratio, min_per_char) if parts[k] else [(0, int(length[k]), ratio[k], family[k])]
                for x, y, r, f in found:
                    start = int(np.count_nonzero((data[ends[doc] : a + x] & 0xC0) != 0x80))
                    out.append((low + doc, start, start + y - x, self.families[f], round(float(r), 4)))
        return out


def train(labelled: list[tuple[str, str]] | None = None) -> Model:
    """Fits on (text, label) rows, among them some with the label ``ordinary``; by default on samples()."""
    return Model(samples() if labelled is None else labelled)


def scan(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """(doc_id, start, end, family, ratio): a row for each secret."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.scan(b.column(1), **options)
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(x, t) for x, t in zip(columns[1:], (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True))], ["doc_id", "start", "end", "family", "ratio"])

    rows = docs.where("text is not null").selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, start long, end long, family string, ratio double")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
