"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import unicodedata
from collections import Counter

import corpus_pipeline
from lodeframe.llm.packing import CAPACITY

from brute import brute_counts, brute_ids, brute_mix, brute_near, normal


def good(text):
    n, chars, symbols, dup, _, failed = brute_counts(text)
    letters = [c for c in text or "" if unicodedata.category(c).startswith("L")]
    lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in (text or "").split("\n"))
    upper = sum(unicodedata.category(c) == "Lu" for c in letters)
    return not (failed or symbols * 10 > n * 3 or dup * 10 > lines * 6 or not 2 * n <= chars <= 15 * n or upper * 10 > len(letters) * 6 or len(letters) * 2 < chars or (text or "").count("!") * 2 > n)


def firsts(docs, key):
    out = {}
    for d in sorted(docs, key=lambda d: d[0]):
        out.setdefault(key(d), d)
    return list(out.values())


def test_stages_match_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    near = lambda rows: brute_near([(i, t) for i, t, _ in rows], corpus_pipeline.NEAR)
    plain = [
        lambda rows: [d for d in rows if good(d[1])],
        lambda rows: firsts(rows, lambda d: normal(d[1])),
        lambda rows: [d for d, (_, root) in zip(sorted(rows), near(rows).values(), strict=True) if root == d[0]],
    ]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or name == "best_fit_packing"
        if k < 3:
            rows = plain[k](rows)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d[0] for d in rows), name
        elif name == "source_mixing":
            words = {}
            for r in docs.collect():
                words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
            assert words == {r[0]: n for r, n in zip(rows, brute_mix(rows), strict=True) if n}
            assert list(docs.columns) == columns
            tokens = sum(map(len, brute_ids([r.text for r in docs.collect()])))
    pieces = docs.collect()
    assert sum(r.length for r in pieces) == tokens == sum(len(r.ids) for r in pieces)
    assert len({(r.row_id, r.piece) for r in pieces}) == len(pieces)
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= CAPACITY and len(ends) <= 1.1 * tokens / CAPACITY + 1


PROSE = "It was a quiet morning in the old town and nobody had yet opened the shutters of the small houses along the river"


def test_odd_tables_pass_through(spark, sf_dir, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:06}")
    other = " ".join(word(k) for k in range(60))
    long = " ".join(word(k) for k in range(200_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, PROSE, None, None, 9), (3, PROSE, None, None, 9), (None, PROSE, "en", "s", 5), (None, other, "en", "s", 5), (9, other.replace(" ", " \n"), "en", "s", 7), (8, long, "en", "s", 1),
    ]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, id long, tag long, size long, rank string, shard int, mix_shard int, words int, whole_row string"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "r", 4, 5, 6, "x") for r in rows], kinds)
    stay = [{3: 2, None: 2, 9: 1, 8: 1}, {3: 2, 9: 1, 8: 1}, {3: 2, 9: 1, 8: 1}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
        if k < 3:
            assert Counter(r.doc_id for r in docs.collect()) == stay[k], name
    assert {r.doc_id for r in docs.collect()} == {3, 9, 8} and sum(r.doc_id == 8 for r in docs.collect()) > 100


def test_empty_tables_pass_through(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (out.columns == docs.columns or name == "best_fit_packing")


def test_near_dedup_stage_links_from_eighty_percent(spark, sf_dir):
    # sets of 100 shingles; m other words at the end leave 100 - m of them: similarity 0.835 (9), 0.802 (11), 0.786 (12)
    text = lambda n, m: " ".join([f"w{n}x{k}" for k in range(104 - m)] + [f"y{n}x{k}" for k in range(m)])
    rows = [(10 * n + k, text(n, m)) for n in range(20) for k, m in enumerate((0, (9, 11, 12)[n % 3]))]
    kept = {percent: sorted(i for i, (_, root) in brute_near(rows, percent).items() if i == root) for percent in (80, 85)}
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == kept[80] != kept[85]


def test_run_writes_each_stage_and_reads_it_again(spark, sf_dir, monkeypatch):
    sizes = []
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, keep=corpus_pipeline.stored: sizes.append(1) or keep(df))
    out = corpus_pipeline.run(spark, sf_dir)
    assert len(sizes) == len(corpus_pipeline.STAGES) and all("table-" in f for f in out.inputFiles()) and out.count() > 0
