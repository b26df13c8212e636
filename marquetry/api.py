"""One object for scoring and splitting, on lists of texts or on DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .operators.score import RuleScorer, Scorer, predict_proba, probabilities
from .operators.segment import RULE_THRESHOLD, Options, Style, segment, style_threshold


class Segmenter:
    """Splits texts with a scorer.

    mixtures: language -> style -> (classifier, features, punctuation's threshold, newline's threshold); with a style, its
    classifier (coefficients, intercept) turns the scorer's features into sentence probabilities, and its threshold is used.
    """

    def __init__(self, scorer: Scorer | None = None, language: str | None = None, mixtures: dict | None = None, threshold: float = RULE_THRESHOLD):
        self.scorer, self.language, self.mixtures, self.threshold = scorer or RuleScorer(), language, mixtures or {}, threshold

    def get_threshold(self, lang: str, style: str, return_punctuation_threshold: bool = False) -> float:
        return style_threshold(self.mixtures, lang, style, return_punctuation_threshold)

    def _style(self, style: str | None, lang: str | None) -> Style | None:
        if style is None:
            return None
        if (lang or self.language) is None:
            raise ValueError("a style needs a language")
        return Style(self.mixtures, style)

    def _batches(self, texts: Iterable[str], size: int, remove_spaces: bool) -> Iterator[tuple[str, np.ndarray]]:
        rows = iter(texts)
        while part := list(islice(rows, size)):
            yield from zip(part, probabilities(self.scorer, part, [self.language] * len(part), remove_spaces), strict=True)

    def predict_proba(self, text_or_texts, lang_code: str | None = None, style: str | None = None, outer_batch_size: int = 1000, remove_whitespace_before_inference: bool = False, return_paragraph_probabilities: bool = False):
        """A vector for one text, else an iterator of vectors; with paragraph probabilities pairs of vectors."""

        chosen, lang = self._style(style, lang_code), lang_code or self.language

        def each(texts):
            for _, p in self._batches(texts, outer_batch_size, remove_whitespace_before_inference):
                own = chosen.probabilities(p, lang) if chosen else p
                yield (own, p) if return_paragraph_probabilities else own

        return next(each([text_or_texts])) if isinstance(text_or_texts, str) else each(text_or_texts)

    def split(self, text_or_texts, lang_code: str | None = None, style: str | None = None, threshold: float | None = None, outer_batch_size: int = 1000,
              remove_whitespace_before_inference: bool = False, do_paragraph_segmentation: bool = False, **options):
        """Segments of one text, else an iterator of segments; with paragraphs, lists of lists."""
        if threshold is not None:
            options |= {"threshold": threshold, "explicit_threshold": True}
        else:
            options["threshold"] = self.get_threshold(lang_code or self.language, style, True) if style else self.threshold
        chosen, own = Options(paragraphs=do_paragraph_segmentation, **options), self._style(style, lang_code)
        lang = lang_code or self.language

        def each(texts):
            for text, p in self._batches(texts, outer_batch_size, remove_whitespace_before_inference):
                found = chosen.split(text, own.probabilities(p, lang) if own else p, lang, p)
                yield found if do_paragraph_segmentation else found[0]

        return next(each([text_or_texts])) if isinstance(text_or_texts, str) else each(text_or_texts)

    def split_frame(self, df: DataFrame, text: str = "text", lang_code: str | None = None, style: str | None = None, lang: str | None = None, out: str = "segments", **options) -> DataFrame:
        """The same on a column, with the segmenter's language, or that of the column lang; see operators.segment.segment()."""
        if style is None and "threshold" not in options and options.get("max_length") is None and options.get("min_length", 1) <= 1:
            options["threshold"] = self.threshold
        own = Style(self.mixtures, style) if lang and style else self._style(style, lang_code)
        return segment(df, self.scorer, text, self._lang(lang_code, lang), out, own, **options)

    def predict_frame(self, df: DataFrame, text: str = "text", lang_code: str | None = None, style: str | None = None, lang: str | None = None, out: str = "probs", return_paragraph_probabilities: bool = False, **options) -> DataFrame:
        """Adds array<float>, or struct<sentence, newline> of both kinds of probabilities."""
        own = Style(self.mixtures, style) if lang and style else self._style(style, lang_code)
        return predict_proba(df, self.scorer, text, self._lang(lang_code, lang), out, style=own, both=return_paragraph_probabilities, **options)

    def _lang(self, lang_code: str | None, column: str | None):
        return F.col(column) if column else F.lit(lang_code or self.language).cast("string")
