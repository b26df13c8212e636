import gzip
import json

from pyspark.sql import functions as F

from marquetry.sources import readers as R, sinks as W
from marquetry.streaming.segments import read_texts, segment_stream, write_segments


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.txt.gz", "wt", encoding="utf8") as f:
        f.write("one\n\n two \nthree\n")
    assert rows(R.sentence_lines(spark, str(tmp_path)), "sent_idx", "sentence") == [(0, "one"), (2, "two"), (3, "three")]
    assert rows(R.sentence_lines(spark, str(tmp_path), limit=3), "sentence") == [("one",), ("two",)]


def test_conllu(spark, tmp_path):
    (tmp_path / "x.conllu").write_text("# newdoc id = a\n# text = A b.\n1\tA\n\n# text = C.\n1\tC\n\n# newdoc id = b\n# text = D.\n")
    df = R.conllu(spark, str(tmp_path), documents=True)
    assert rows(df, "doc_id", "sentence") == [(1, "A b."), (1, "C."), (2, "D.")]
    assert {r["doc_id"] for r in R.conllu(spark, str(tmp_path)).collect()} == {0}


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(json.dumps({"text": "ä😀b cd", "spans": [{"start": 0, "end": 3}, {"start": 4, "end": 6}]}) + "\n")
    assert rows(R.jsonl_spans(spark, str(tmp_path)), "sent_idx", "sentence") == [(0, "ä😀b"), (1, "cd")]


def test_tsv(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("A\t0\nb\t1\nbroken\nC\t1\nrest\t0\n")
    assert rows(R.boundary_words(spark, str(tmp_path)), "sent_idx", "sentence") == [(0, "A b"), (1, "C")]
    (tmp_path / "x.tsv").write_text("so\tCOMMA\nit\tO\nis\tPERIOD\n")
    assert rows(R.punctuated_tokens(spark, str(tmp_path)), "start", "end", "label") == [(0, 2, "COMMA"), (3, 5, "O"), (6, 8, "PERIOD")]


def test_json_tables(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"stats": {"xx": {"target_length": 5, "spread": 2}}}))
    assert rows(R.lengths_json(spark, str(tmp_path / "l.json")), "lang", "target_length", "spread") == [("xx", 5, 2)]
    (tmp_path / "i.json").write_text(json.dumps({"en": {"d": {"s": [{"predicted_indices": [1], "true_indices": [1, 2], "length": 3}]}}}))
    assert rows(R.boundary_indices(spark, str(tmp_path / "i.json")), "lang", "dataset", "system", "doc_id", "length") == [("en", "d", "s", 0, 3)]
    (tmp_path / "c.csv").write_text("lang,ud\naf,x\n")
    assert rows(R.language_csv(spark, str(tmp_path / "c.csv")), "lang", "ud") == [("af", "x")]
    (tmp_path / "m.json").write_text(json.dumps({"lang": "en", "style": "ud", "coefficients": [1.0], "intercept": 0.5, "punctuation": 0.2, "newline": 0.3}))
    assert R.mixtures(spark, str(tmp_path / "m.json")).first()["newline"] == 0.3


def test_pairs(spark, tmp_path):
    df = spark.createDataFrame([("a", " a "), ("a", "b")], "l string, r string")
    assert rows(R.parallel(df, "l", "r"), "l", "r") == [("a", "b")]
    for folder, word in (("g", "x"), ("p", "y")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.tsv").write_text(f"{word}\n{word}2\n")
    both = R.paired_files(R.numbered_lines(spark, str(tmp_path / "g")), R.numbered_lines(spark, str(tmp_path / "p")))
    assert rows(both, "line_no", "gold", "predicted") == [(0, "x", "y"), (1, "x2", "y2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("de", 0, "a", 1), ("en", 1, "b", 0)], "lang string, k long, word string, label int")
    W.write_corpus(df, f"{tmp_path}/c")
    assert rows(R.corpus(spark, f"{tmp_path}/c", ["de"]), "k") == [(0,)]
    W.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    W.write_csv(df, f"{tmp_path}/v")
    assert spark.read.csv(f"{tmp_path}/v", header=True).count() == 2
    W.write_labelled_words(df, f"{tmp_path}/t", order=["k"])
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/t").collect()] == ["a\t1", "b\t0"]
    W.write_labelled_words(df, f"{tmp_path}/f", file="lang", order=["k"])
    assert rows(spark.read.text(f"{tmp_path}/f"), "lang", "value") == [("de", "a\t1"), ("en", "b\t0")]
    assert W.append_missing(df, f"{tmp_path}/m", ["k"]) == 2
    assert W.append_missing(df.withColumn("k", F.col("k") + 1), f"{tmp_path}/m", ["k"]) == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "A. B."), (2, "C.\nD")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = read_texts(spark, f"{tmp_path}/in", "doc_id long, text string", per_trigger=1)
    write_segments(segment_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    write_segments(segment_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    want = [(1, 0, "A. "), (1, 1, "B."), (2, 0, "C.\n"), (2, 1, "D")]
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "doc_id", "seg_idx", "segment") == want
    write_segments(segment_stream(stream, max_length=3, split_on_input_newlines=False), f"{tmp_path}/out2", f"{tmp_path}/state2")
    assert max(len(r["segment"]) for r in spark.read.parquet(f"{tmp_path}/out2").collect()) <= 3


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = {name: [f"{name} {i} " + "x" * (i * 7 % 50) for i in range(n)] for name, n in (("a", 700), ("b", 1), ("c", 300))}
    for name, own in lines.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(own) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = R.numbered_lines(spark, str(tmp_path))
        got = {(r["file"][-5], r["line_no"]): r["line"] for r in df.collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(name, i): x for name, own in lines.items() for i, x in enumerate(own)}


def test_folders_of_several_files(spark, tmp_path):
    """One language's lines are written by several tasks, and read as one file; sentences may go on in the next file."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        words = spark.range(400).selectExpr("'en' as lang", "id as k", "concat('w', id) as word", "cast(id % 5 = 4 as int) as label")
        W.write_labelled_words(words, f"{tmp_path}/w", file="lang", order=["k"])
        assert len(list((tmp_path / "w" / "lang=en").glob("*.txt"))) > 2
        got = rows(R.boundary_words(spark, f"{tmp_path}/w", folders=True), "sent_idx", "sentence")
        lines = rows(R.numbered_lines(spark, f"{tmp_path}/w", folders=True), "line_no", "line")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [(i, " ".join(f"w{5 * i + j}" for j in range(5))) for i in range(80)]
    assert lines == [(i, f"w{i}\t{int(i % 5 == 4)}") for i in range(400)]
