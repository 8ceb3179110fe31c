from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_texts, packing, quality, sharding, tokens, toxicity, url_filter

pipeline = pytest.importorskip("corpus_pipeline")


def whole(df):
    return Counter(str(r) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that share ids, differ in one column only, repeat, have no id or no text, and columns of internal names."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, text, "en", "a", 5), (1, text, "de", "a", 5), (1, "quite another text of more than five words " * 3, "en", "a", 5), (2, text + " tail", "en", "b", 1),
        (2, text + " tail", "en", "b", 1), (None, text, "fr", None, 2), (None, "no id but enough words to be a document", "fr", None, 2), (3, None, "en", "b", 0),
        (4, "", "en", "b", 0), (5, "one two", "en", "c", 7), (6, "long " * 30_000, "en", "c", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {"row": F.lit(1), "offset": F.lit("o"), "_score": F.lit(0.1), "sequence_id": F.lit("s"), "_crc": F.lit(7), "_spans": F.lit(8), "kept": F.lit(False), "m": F.create_map(F.lit("k"), "doc_id")}
    return df.withColumns(clash)


def test_every_stage_on_odd_rows(spark, odd, sf_dir):
    docs = odd
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.dtypes == odd.dtypes
        if name != "mixing":  # whole rows of its input stay, each at most as often as it stood there
            assert not whole(got) - whole(docs)
        assert stage(spark, odd.where("false"), sf_dir).count() == 0
    assert pipeline.STAGES[-1][1](spark, odd, sf_dir).count() >= odd.count()


def test_near_copies_by_rows(spark, odd, sf_dir):
    """Against the groups read off by hand: rows of one id are documents of their own, near copies lose all but one."""
    got = pipeline.drop_near_copies(spark, odd, sf_dir)
    texts = Counter((r.text or "")[:20] for r in got.collect())
    assert texts == Counter({(t or "")[:20]: 1 for t in ["w0 w1 w2 w3 w4 w5 w6 w7", "quite another text o", "no id but enough wor", "one two", "long long long long long", ]} | {"": 2})
    assert [r.doc_id for r in got.where("text like 'w0 %'").collect()] == [1]


def test_mixing_keeps_each_row_its_own(spark, odd, sf_dir):
    """Every row that the mix returns is an input row but for the text, of which it has the taken words, and n_chars."""
    got = pipeline.mix_sources(spark, odd, sf_dir).collect()
    rest = lambda r: str([v for k, v in r.asDict().items() if k not in ("text", "n_chars")])
    of = {}
    for r in odd.collect():
        of.setdefault(rest(r), []).append(Counter((r.text or "").split()))
    seen = Counter()
    for r in got:
        assert r.n_chars == len(r.text)
        assert any(not Counter(r.text.split()) - words for words in of[rest(r)])
        seen[r.lang, r.doc_id] += 1
    assert {("en", 1), ("de", 1)} <= set(seen)


def test_kept_rows_against_the_scores(spark, sf_dir):
    """The filters keep just the whole rows whose score says so."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for module, stage, keep in ((quality, pipeline.keep_quality, lambda s: s >= 0.3), (toxicity, pipeline.drop_toxic, lambda s: s < 0.5)):
        scored = module.score(docs, module.fit(docs, labels), column="s").collect()
        want = Counter(str(r) for r in spark.createDataFrame([[r[c] for c in docs.columns] for r in scored if keep(r.s)], docs.schema).collect())
        assert whole(stage(spark, docs, sf_dir)) == want


def test_clashing_columns(spark, docs, vocab):
    """Added columns replace those of their names, whatever the case; all others stay."""
    clash = docs.withColumns({"Score": F.lit("x"), "_text": F.lit("y"), "_url": F.lit("z"), "HOST": F.lit("h"), "offset": F.lit("o"), "_item": F.lit("i"), "_bucket": F.lit("b"), "length": F.lit(3)})
    assert quality.score(clash, quality.fit_features(quality.np.zeros((0, 20)), quality.Pool(quality.np.zeros((0, 20))))).columns == [c for c in clash.columns if c != "Score"] + ["score"]
    assert toxicity.score(clash, toxicity.constant(0.5)).columns == [c for c in clash.columns if c != "Score"] + ["score"]
    out = url_filter.judge(clash.withColumn("url", F.lit("http://a.org/")), url_filter.fit(spark))
    assert out.columns == [*[c for c in clash.columns if c != "HOST"], "url", "host", "path", "rule", "blocked", "verdict"] and out.first()._url == "z"
    assert packing.pack(clash, "length", 10, ["doc_id", "offset"]).columns == [*[c for c in clash.columns if c != "offset"], "sequence_id", "offset"]
    assert len(packing.pack_documents(clash, vocab, 64, keep=["doc_id", "offset", "_text", "length"]).columns) == 8
    assert tokens.prefix_counts(clash, "text", vocab).columns[-3:] == ["n_bytes", "n_tokens", "steps"]
    documents, spans = mixing.mix(docs.select("doc_id", "source", F.lit(3).alias("row"), F.lit(4).alias("w")), size="w", order=["doc_id", "row"], carry=["row", "source"])
    assert documents.columns == ["doc_id", "source", "sid", "row", "size", "source_size", "target"] and documents.count() == docs.count()
    with pytest.raises(ValueError):
        sharding.shard_rows(docs.select("doc_id", "shard"), "doc_id", sharding.topology(16))
    assert near_texts.near_duplicates(clash).columns == ["doc_id", "n_shingles", "component_id", "kept"]
