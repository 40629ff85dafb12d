"""Text functions against plain Python rules, on rows that break naive regular expressions."""

import regex
from pyspark.sql import functions as F

from corpuscape.functions import text as tx
from corpuscape.operators import rows
from corpuscape.sources import readers

TEXTS = [
    "Ab_c 12.5 007 05 99 100 5ä ä5 3",
    "",
    "  x y　z\x1cq ",
    "İSTANBUL ẞ ΟΔΟΣ éx n⁀m ½ ² ⅷ",
    "a\nb\tc",
    "x" * 2100,
    " ".join("abcdefghij"[i % 10] for i in range(451)),
    "der Der DER derart",
    "der die und the of",
    "word " * 700,
]


def apply(spark, fn):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    return [r[0] for r in table.repartition(3).select("id", fn(F.col("text")).alias("r")).orderBy("id").select("r").collect()]


def small_numbers(t):
    gone = regex.sub(r"(?<![\p{L}\p{N}_])[1-9]?[0-9](?![\p{L}\p{N}_])", "", t.lower())
    return " ".join(gone.split())


def cap_chars(t, n=2015):
    if len(t) <= n:
        return t
    cut = t[:n].rfind(" ")
    return t[:n] if cut < 0 else t[:cut]


def test_counts(spark):
    assert apply(spark, tx.char_count) == [len(t) for t in TEXTS]
    assert apply(spark, tx.word_count) == [len(t.split()) for t in TEXTS]


def test_tokens(spark):
    assert apply(spark, tx.tokenize_words) == [regex.findall(r"[\p{L}\p{N}_]+", t) for t in TEXTS]


def test_lower(spark):
    assert apply(spark, tx.lowercase) == [t.lower() for t in TEXTS]


def test_small_numbers(spark):
    assert apply(spark, tx.remove_small_numbers) == [small_numbers(t) for t in TEXTS]
    assert apply(spark, tx.small_number_count)[0] == 4


def test_caps(spark):
    assert apply(spark, tx.cap_words) == [" ".join(t.split()[:450]) for t in TEXTS]
    assert apply(spark, tx.cap_chars_word_boundary) == [cap_chars(t) for t in TEXTS]


def test_truncation_is_a_prefix_and_fits(spark):
    cut = apply(spark, tx.truncate_tokens)
    assert all(t.startswith(c) for t, c in zip(TEXTS, cut))
    table = spark.createDataFrame([(c,) for c in cut], "text string")
    assert table.agg(F.max(tx.count_tokens(F.col("text")))).first()[0] <= 501


def test_idempotence(spark):
    for fn in (tx.squeeze_spaces, tx.cap_words, tx.cap_chars_word_boundary):
        assert apply(spark, lambda t: fn(fn(t))) == apply(spark, fn)


def test_stopword_forms_agree(spark):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    stop = spark.createDataFrame([("Der",), (" die ",), ("und",), ("the",), ("of",)], "word string")
    words = readers.clean_word_list(stop, "word")
    joined = {r["id"]: r["text"] for r in rows.stopword_anti_join(table, words).collect()}
    listed = {r["id"]: r["text"] for r in rows.remove_stopwords(table, words).collect()}
    assert joined == listed
    assert joined[8] == "" and joined[7] == "derart" and len(joined) == len(TEXTS)


def test_tokenizer_plug_in(spark):
    def load():
        def encode(texts):
            return [[(0, 0)] + [m.span() for m in regex.finditer(r"\S+", t)] + [(0, 0)] for t in texts]

        return encode

    counts = apply(spark, lambda t: tx.count_tokens(t, load))
    assert counts[4] == 5 and counts[9] == 702
    cut = apply(spark, lambda t: tx.truncate_tokens(t, 10, load))
    assert cut[9] == " ".join(["word"] * 9)


def test_json_lines(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    lines = ['{"id": "Q42"}', '{"id": 8.5}', '{"id": 1, "title": "t", "text": "x y"}', "", "nope", "[1]", '{"id": "7", "text": null}', '{"id": 3}']
    (deep / "part_00").write_text("\n".join(lines[:5]), encoding="utf-8")
    (tmp_path / "part_01").write_text("\n".join(lines[5:]), encoding="utf-8")
    found = readers.scan_jsonl_dir(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in found] == [
        ("1", "t", "x y"),
        ("3", "", ""),
        ("7", "", ""),
        ("8.5", "", ""),
        ("Q42", "", ""),
    ]


def test_stopword_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text(" der \n\nDer\nund\n", encoding="utf-8")
    found = {r["word"] for r in readers.load_stopwords(spark, str(tmp_path / "words.txt")).collect()}
    assert found == {"der", "und"}


def test_stopword_case_and_repeated_keys(spark):
    docs = spark.createDataFrame([(1, "Der Hund"), (1, "die Katze der"), (None, "der Fisch"), (2, None)], "id long, text string")
    stop = spark.createDataFrame([("Der",), ("DIE",)], "word string")
    expected = [(1, "hund"), (1, "katze"), (2, None), (None, "fisch")]
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    for found in (
        rows.remove_stopwords(docs, ["Der", "DIE"]),
        rows.remove_stopwords(docs, stop),
        rows.stopword_anti_join(docs, stop),
        rows.stopword_anti_join(docs, stop, bound=2),
    ):
        assert order(found.collect()) == order(expected)


def test_inventory_tells_folders_apart(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(10).selectExpr("id", "id % 2 as g").coalesce(1).write.partitionBy("g").parquet(path)
    found = readers.table_inventory(spark, path).collect()
    assert len(found) == 2 and all(r.n_rows == 5 and r.n_row_groups == 1 and r.n_bytes > 0 and "g=" in r.file for r in found)
