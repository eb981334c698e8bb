"""The registered queries on the smallest tables, and the pipeline stage by stage on a small corpus."""

import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
import oracle
from factloom.llm import mixing
from factloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
given = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not there")


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@given
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name, monkeypatch):
    import factloom.queries
    monkeypatch.setattr(factloom.queries, "QUERIES", QUERIES)
    monkeypatch.setattr(factloom.queries, "ORACLES", ORACLES)
    assert oracle.compare(spark, oracle.duck(FOLDER), name, FOLDER) == ""


@given
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_or_more_per_document(spark, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    got = [r.doc_id for r in QUERIES[name](spark, FOLDER).select("doc_id").collect()]
    assert set(got) == ids and (name.startswith("op8") or len(got) == len(ids))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """60 clean texts in three sources, 20 with a toxic word, copies and near copies."""
    rng, folder = random.Random(7), tmp_path_factory.mktemp("corpus")
    words = [f"{a}{b}" for a in ("ba", "do", "mi", "su", "te") for b in ("lan", "rek", "vos", "nim", "tup", "sar")]
    def text(n, bad=False):
        body = [rng.choice(words) + str(rng.randrange(99)) for _ in range(n)]
        if bad:
            body[rng.randrange(n)] = "vileword"
        return " ".join(body)
    clean = {i: text(rng.randrange(30, 120)) for i in range(60)}
    toxic = {100 + i: text(60, True) for i in range(60)}
    copies = {200 + i: clean[i].upper() for i in range(10)}
    near = {}
    for i in range(10, 20):
        near[200 + i] = clean[i] + " more"
    every = clean | toxic | copies | near
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in every.items()] + [(900, None, None, None, None), (901, "", "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, int(i in toxic)) for i in every if i < 200]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), clean, toxic, copies, near


def test_stages(spark, corpus):
    folder, clean, toxic, copies, near = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = corpus_pipeline.saved(stage(spark, docs, folder))
        seen.append((name, before, docs.collect()))
        assert k == 4 or docs.columns == columns
    assert [s[0] for s in seen] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]

    kept = {r.doc_id for r in seen[0][2]}
    held_out = [i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held_out) > 3 and not kept & set(toxic) and kept >= set(clean) | set(copies) | set(near) | {900, 901}

    groups = defaultdict(list)
    for r in seen[1][1]:
        groups[(r.text or "").lower()].append(r.doc_id)
    assert {r.doc_id for r in seen[1][2]} == {max(g) for g in groups.values()}

    assert {r.doc_id for r in seen[1][2]} - {r.doc_id for r in seen[2][2]} == set(near)

    sizes, taken = Counter(), Counter()
    for r in seen[3][1]:
        sizes[r.source] += len((r.text or "").split())
    for r in seen[3][2]:
        taken[r.source] += len(r.text.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.word_targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)
    for name, target in zip(names, want):
        assert abs(taken[name] - target) <= max(corpus_pipeline.BLOCK_WORDS, 0.02 * target)

    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    pieces = Counter()
    for r in seen[4][1]:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [1]
        pieces[r.doc_id, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in seen[4][2]) == pieces
    total = sum(r.length for r in seen[4][2])
    assert len({r.sequence_id for r in seen[4][2]}) <= -(-total // 4096) + 1


def test_run_is_its_stages(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0]).collect()
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, corpus[0]))
    key = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(got) == key(docs.collect())
