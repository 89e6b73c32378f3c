"""Queries against their SQL, and the pipeline against its stages' rules."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from isotherm.llm import jaccard_join, queries, suffix_dedup, toxicity  # noqa: E402
from test_catalog import connection, rows  # noqa: E402
from test_edges import brute_masked, shingle_set, words  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(x) for x in df.collect()])
    cur = connection(DATA).execute(queries.ORACLE_SQL[name])
    assert got == rows([x[0] for x in cur.description], cur.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, DATA).cache()
        assert out.columns == columns, name
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        assert set(after) <= set(before) and len(after) > len(before) / 2
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
            assert set(before) - set(after) == bad
        if name == "secret_scans":
            assert set(after) == set(before)
        else:
            assert all(after[k] == before[k] for k in after)
        docs = out
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_edges(spark):
    """Nulls, blanks, repeated rows and clashing columns through every stage; contamination and masking by plain rules."""
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("size(split(text, ' ')) > 8").first().text
    plain = "these are the quiet words of an ordinary page about rivers and hills and trees"
    texts = [(1, None), (2, ""), (3, plain), (3, plain), (None, None), (4, f"{plain} then {item} and more"), (5, "a page with token=abcdef123 in its midst and nothing else of note here")]
    docs = spark.createDataFrame([(i, t, "x", "y", 0.5, 7) for i, t in texts], "doc_id long, text string, found string, _blob string, _score double, row int")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, DATA).cache()
        assert out.columns == docs.columns, name
        docs = out
    left = sorted(((r.doc_id, r.text, r.found, r._blob, r._score, r.row) for r in docs.collect()), key=repr)
    want = [(1, None), (2, ""), (3, plain), (None, None), (5, texts[-1][1].replace("token=abcdef123", "[SECRET]"))]
    assert left == sorted(((i, t, "x", "y", 0.5, 7) for i, t in want), key=repr)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sorted((r.doc_id, r.piece) for r in packed if r.doc_id is not None) == [(1, 0), (2, 0), (3, 0), (5, 0)] and len(packed) == 5


def test_chunks_of_any_size_give_the_same(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for apply in (jaccard_join.jaccard_components, suffix_dedup.suffix_dedup):
        one, two = (sorted(map(tuple, apply(docs, chunk_bytes=n).collect())) for n in (1 << 15, 1 << 22))
        assert one == two and len(one) == docs.count()


def test_stages_on_near_copies(spark):
    """Near copies of many degrees, contaminated ones among them, by plain sets; then secrets in what is left."""
    g = random.Random(21)
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(r.text.split()) > 8]
    rows = []
    for k in range(12):
        base = words(70, 500 + k).split()
        if k % 4 == 0:
            base[30:30] = items[k].split()
        for _ in range(8):
            w = list(base)
            for _ in range(g.randrange(7)):  # up to 7 words in other places: from copies to texts of their own
                w[g.randrange(len(w))] = "changed" + str(g.randrange(9))
            if g.random() < 0.2:
                w[5] = "token=abcdef123"
            rows.append((len(rows), " ".join(w)))
    g.shuffle(rows)
    want = {i for i, c in component_of(rows).items() if i == c}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = corpus_pipeline.drop_near_copies(spark, docs, DATA).cache()
    assert {r.doc_id for r in once.collect()} == want and 12 < len(want) < 90
    texts = dict(rows)
    item_sets = [shingle_set(t, min(5, len(t.split()))) for t in (r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()) if t and t.split()]
    dirty = {i for i in want if any(5 * len(x & shingle_set(texts[i], len(next(iter(x))))) >= 4 * len(x) for x in item_sets)}
    clean = corpus_pipeline.drop_contaminated(spark, once, DATA).cache()
    assert {r.doc_id for r in clean.collect()} == want - dirty and dirty
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, clean, DATA).collect()}
    assert masked == {i: brute_masked(texts[i]) for i in want - dirty}


def component_of(rows):
    """Least id reachable by links of five-word shingles, 0.8 or more."""
    sets = {i: shingle_set(t, 5) for i, t in rows}
    least = {i: i for i in sets}
    while True:
        before = dict(least)
        for i in sets:
            for j in sets:
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
        if least == before:
            return least
