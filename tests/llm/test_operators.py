"""The operators on small frames: odd rows, ties, repeated rows, empty tables, extra columns, and hot groups."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import exact, language, linededup, mixing, neardup, packing, pseudonyms, quality, shards, tokens, toxicity
from factloom.llm.common import running_start
from factloom.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, node int, s string"
LONG = "word " * 30_000


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", 1, None) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    prose = [" ".join(rng.choice(["the", "sun", "and", "moon", "rise", "over", "hills", "of", "stone"]) + str(rng.randrange(50))
                      for _ in range(60)) for _ in range(4)]
    return [(1, prose[0], "en", "a"), (2, prose[0].upper(), "en", "a"), (3, prose[1], None, None), (3, prose[1], None, None),
            (4, None, "en", "b"), (5, "", None, "b"), (6, " \n\t ", "de", None), (None, prose[2], "de", "c"),
            (None, None, None, None), (7, LONG, "en", "a"), (8, "é ñ ü", "fr", "c"), (9, prose[3] + "\n" + prose[0], "en", "b"),
            (10, prose[0] + " more", "en", "c"), (3, prose[2], "de", "a"), (11, "1 2 3", "de", "c")]


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_running_start(spark):
    rows = [(g, i % 3, i, i * 2) for g in ("a", None) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, b int, i int, v long")
    got = {(r.g, r.i): r.start for r in running_start(df, ["g"], "b", ["i"], "v").collect()}
    for g in ("a", None):
        total = 0
        for _, b, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            assert got[g, i] == total
            total += v


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    parent = list(range(500))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for link in links for i in link if link[0] != link[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [2, 1000])
def test_content_groups(spark, odd, hot):
    groups = defaultdict(list)
    for i, t, *_ in odd:
        groups[lower(t)].append(i)
    got = exact.content_groups(frame(spark, odd), hot_rows=hot, salts=3).collect()
    assert len(got) == len(odd)
    for t, ids in groups.items():
        sha = hashlib.sha256(t.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        best = max(ids, key=lambda i: -1 if i is None else i)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in mine)
        assert {(r.keep_id, r.group_size) for r in mine} == {(best, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [best]
    kept = exact.distinct_documents(frame(spark, odd), hot_rows=hot, salts=3)
    assert kept.columns == frame(spark, odd).columns
    assert Counter(lower(r.text) for r in kept.collect()) == Counter(groups.keys())
    assert exact.content_groups(frame(spark, [])).count() == exact.distinct_documents(frame(spark, [])).count() == 0


def test_shards_fit(spark, odd):
    rows = odd + [(100 + i, "x" * (i % 50), "en", "a") for i in range(300)] + [(5000, "y" * 30, "en", "a")] * 9
    got = shards.extendible_shards(frame(spark, rows), 200).collect()
    size, count = Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        size[r.shard, r.page] += r.bytes
        count[r.shard, r.page] += 1
    for r in got:
        assert (r.shard_bytes, r.shard_rows) == (size[r.shard, r.page], count[r.shard, r.page])
        assert r.shard_bytes <= 200 or r.shard_rows == 1
        assert r.shard >> r.depth == 1
    nodes = {r.shard for r in got}
    assert not any(s >> k in nodes for s in nodes for k in range(1, s.bit_length()))  # no shard inside another
    total = defaultdict(int)
    for r in got:
        for k in range(r.shard.bit_length()):
            total[r.shard >> k] += r.bytes
    assert all(total[s >> 1] > 200 for s in nodes if s > 1)  # nothing was split without need
    assert shards.extendible_shards(frame(spark, []), 200).count() == 0


def test_write_shards(spark, tmp_path):
    rows = [(i, "x" * 20, "en", "a") for i in range(100)]
    shards.write_shards(frame(spark, rows), str(tmp_path / "out"), 300)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    assert back.groupBy("shard", "page").agg(F.sum(F.length("text")).alias("n")).where("n > 300").count() == 0


def test_mix_meets_targets(spark, odd):
    rng = random.Random(4)
    rows = odd + [(100 + i, " ".join(["w"] * rng.randrange(200)), "en", rng.choice(["a", "b", "b", "c", None])) for i in range(200)]
    docs = frame(spark, rows)
    mixed_rows, spans = mixing.source_mix(docs, block_words=16, slots_per_shard=256)
    got = mixing.taken_words(mixed_rows, spans).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.word_targets([sizes[n] for n in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2)))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.row_source] and r.target == pytest.approx(want[r.row_source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.row_source] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 16 + 0.01 * want[s]
    again = mixing.taken_words(*mixing.source_mix(docs.repartition(5), block_words=16, slots_per_shard=256)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)
    parts = mixing.mixed_documents(docs, mixed_rows, spans)
    assert parts.columns == docs.columns
    words, original = Counter(), {}
    for i, t, *_ in rows:
        original.setdefault(i, []).append((t or "").split())
    for r in parts.collect():
        part = r.text.split()
        assert any(part == o[k:k + len(part)] for o in original[r.doc_id] for k in range(len(o) - len(part) + 1))
        assert r.n_chars == len(r.text)
        words[r.doc_id] += len(part)
    want_words = Counter()
    for r in got:
        want_words[r.doc_id] += r.taken
    assert +words == +want_words
    empty_rows, empty_spans = mixing.source_mix(frame(spark, []))
    assert mixing.taken_words(empty_rows, empty_spans).count() == mixing.mixed_documents(frame(spark, []), empty_rows, empty_spans).count() == 0


def test_slots_of_a_mix_stay_off_the_driver(spark):
    """Slots grow with the words, whatever Spark guesses from the few rows that make them; they are never broadcast."""
    docs = frame(spark, [(i, "w " * 50, "en", "ab"[i % 2]) for i in range(200)])
    _, spans = mixing.source_mix(docs, block_words=16, slots_per_shard=256)
    assert len(spans.collect()) > 200
    plan = spans._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "block" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), joins


def brute_classes(rows):
    parts = []
    for i, t, *_ in rows:
        words = lower(t).split()
        parts.append((tuple(words), Counter(tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))) if words else Counter()))
    parent = list(range(len(rows)))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in range(len(rows)):
        for b in range(a):
            x, y = parts[a][1], parts[b][1]
            same = parts[a][0] == parts[b][0]
            if not same and set(x) & set(y):
                every = set(x) | set(y)
                same = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in set(x) & set(y)) >= 0.8
            if same:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for a in range(len(rows)):
        groups[find(a)].append(rows[a][0])
    return sorted(tuple(sorted(map(str, g))) for g in groups.values())


def test_near_classes(spark, odd):
    rng = random.Random(8)
    base = [f"t{rng.randrange(4000)}" for _ in range(150)]
    near = []
    for k in range(40):  # a chain and a cloud of copies with a few other words
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{k}"
        near.append((200 + k, " ".join(words), "en", "a"))
    rows = odd + near + [(300, "one two three", "en", "a"), (301, "One two  three", "en", "b")]
    rows = [r for k, r in enumerate(rows) if r[1] != LONG and k != 13]  # one text per id, so that ids name classes
    got = neardup.near_classes(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.class_id, r.class_size].append(r)
    assert sorted(tuple(sorted(str(r.doc_id) for r in g)) for g in groups.values()) == brute_classes(rows)
    for (class_id, size), g in groups.items():
        assert size == len(g) and sum(r.kept for r in g) == 1
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert class_id == (min(ids) if ids else None)
    left = neardup.one_of_each_class(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert Counter(r.doc_id for r in left.collect() if r.doc_id not in (3, None)) == Counter(
        r.doc_id for r in got if r.kept and r.doc_id not in (3, None))
    assert neardup.near_classes(frame(spark, [])).count() == 0


def test_languages(spark, odd):
    rows = odd + [(1000 + 3 * i + k, t, g, "a") for i in range(12) for k, (t, g) in enumerate(
        (("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")))]
    got = language.languages(frame(spark, rows), F.lit(True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (3, None)}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (4, 5, 6, 11)) and by[8].lang_pred in ("en", "de", "fr")
    assert by[1000].lang_pred == "en" and by[1001].lang_pred == "de" and by[1002].lang_pred == "fr"
    assert language.languages(frame(spark, []), F.lit(True)).count() == 0
    assert {r.lang_pred for r in language.languages(frame(spark, rows), F.lit(False)).collect()} == {"und"}


def test_toxicity_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    docs = frame(spark, odd)
    got = toxicity.toxicity_scores(docs, labels, F.lit(True))
    assert got.columns == docs.columns + ["score", "predicted"]
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t, *_ in odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.score == 0 for r in rows if not (r.text or "").split())
    assert toxicity.toxicity_scores(frame(spark, []), labels.limit(0), F.lit(True)).count() == 0


def test_quality_rows(spark, odd):
    rows = odd + [(400, "a b c d e f g h " * 4, "en", "a"), (401, "x\n\nx\n  \nx\n  ", "en", "a"),
                  (402, "a b c d e f g h i a b c d e f g h j k l m n o p q r s t u v w x y z", "en", "a")]
    got = {r.doc_id: r for r in quality.judged(frame(spark, rows)).collect() if r.doc_id not in (3, None)}
    for i, t, *_ in rows:
        if i in (3, None):
            continue
        words = (t or "").split()
        windows = defaultdict(list)
        for k in range(len(words) - 7):
            windows[tuple(words[k:k + 8])].append(k)
        covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.kept and r.base_failed)
    assert len(quality.judged(frame(spark, rows)).collect()) == len(rows)
    assert quality.judged(frame(spark, [])).count() == 0


def test_quality_finds_noise(spark):
    rng = random.Random(2)
    def prose(n):
        return " ".join(rng.choice("the of and to in is house tree river stone light under".split()) + rng.choice(["", "", ",", "."]) for _ in range(n))
    rows = [(i, prose(120), "en", "a") for i in range(60)] + [(900, "#$% ".join(prose(120).split()), "en", "a")]
    got = {r.doc_id: r for r in quality.judged(frame(spark, rows)).collect()}
    assert not got[900].kept and sum(not r.kept for i, r in got.items() if not r.base_failed) == 1


def test_quality_of_many_languages(spark, monkeypatch):
    rows = [(i, f"w{i} " * 30 + "stone tree river light " * 10, f"l{i % 300}" if i % 7 else None, "a") for i in range(700)]
    got = {r.doc_id: r for r in quality.judged(frame(spark, rows)).collect()}
    assert len(got) == 700 and all(r.word_distance is not None for r in got.values())
    monkeypatch.setattr(quality, "MAX_LANGUAGES", 1000)
    assert {r.doc_id: r for r in quality.judged(frame(spark, rows)).collect()} == got


def test_lines(spark, odd):
    passage = " ".join(f"p{i}" for i in range(60))
    half = "\n".join(" ".join(f"q{j}{i}" for i in range(30)) for j in range(3))
    rows = odd + [(500, f"start\n{passage}\nend", "en", "a"), (501, f"{half}\n{passage}", "en", "a"), (502, half + "\ntail", "en", "a"),
                  (503, "\n".join(["again and again"] * 60), "en", "a"), (504, "short line\nshort line", "en", "a")]
    from test_parts import brute_removed
    rows = [r for r in rows if r[0] not in (3, None)]
    got = {r.doc_id: r for r in linededup.line_report(frame(spark, rows)).collect()}
    want = brute_removed([(i, t) for i, t, *_ in rows if t != LONG], 50)
    assert {i: set(r.removed) for i, r in got.items() if r.removed} == want and 501 in want and 503 in want
    assert all(r.n_lines == len((t or "").split("\n")) for i, t, *_ in rows for r in [got[i]])
    cut = linededup.without_repeated_lines(frame(spark, rows), least_words=50)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[501] == half and texts[502] == "tail" and texts[4] is None and cut.columns == frame(spark, rows).columns
    whole = linededup.line_report(frame(spark, odd)).collect()
    assert len(whole) == len(odd) and linededup.line_report(frame(spark, [])).count() == 0


def test_lines_of_null_and_repeated_ids(spark):
    """All ids, repeated rows, and fingerprints of few and of most rows, against the runs of all texts."""
    from test_parts import brute_removed
    rng = random.Random(9)
    rows = []
    for i in range(120):
        body = "\n".join(rng.choice([" ".join(f"{c}{k}" for k in range(n)) for c, n in zip("abcdefg", (3, 9, 14, 25, 40, 60, 30))] + [""])
                         for _ in range(rng.randrange(9)))
        rows.append((rng.choice([None, i % 7, i]), body if i % 11 else None, "en", "a"))
    rows += rows[:30]
    docs = frame(spark, rows)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    keys = {((i is None, i or 0), hashes[t]): t for i, t, *_ in rows}
    want = brute_removed(list(keys.items()), 50)
    got = {((r._id is None, r._id or 0), r._hash): set(r.removed) for r in linededup.repeated_lines(docs).collect()}
    def solid(found):  # lines without words do not count
        return {k: v for k, lines in found.items() if (v := {n for n in lines if keys[k].split("\n")[n].strip()})}
    assert solid(got) == solid(want) and len(want) > 20
    assert len(linededup.line_report(docs).collect()) == len(rows)


def test_common_keys_meet_like_others(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 3000).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("least")).where("_n > 1")
    both = linededup._met(rows, groups, ["k"], "inner")
    plain = rows.join(groups.drop("_n"), "k")
    assert sorted(map(tuple, both.select("id", "k", "least").collect())) == sorted(map(tuple, plain.select("id", "k", "least").collect()))
    assert linededup._met(rows, groups.select("k", "_n"), ["k"], "left_semi").count() == plain.count()


def test_clashing_names_keep_their_values(spark):
    text = "one two three four five six seven " * 9
    names = "doc_id long, text string, size int, _item int, _text_hash int, sequence_id int, offset int, removed int, _id int, c1 int, _c0 int, _gone_id int"
    docs = spark.createDataFrame([(i, text if i < 2 else f"{i} other", *range(3, 13)) for i in range(4)], names)
    def rest(df):
        return sorted(set(map(tuple, df.select(*docs.columns[2:]).collect())))
    for done in (linededup.without_repeated_lines(docs), neardup.one_of_each_class(docs), exact.distinct_documents(docs)):
        assert done.columns == docs.columns and rest(done) == [tuple(range(3, 13))]
    packed = packing.pack_pieces(docs.withColumn("length", F.length("text")), 512)
    own = [c for c in docs.columns if c not in ("sequence_id", "offset")]
    assert packed.columns == [*own, "length", "sequence_id", "offset"]
    assert sorted(map(tuple, packed.select(*own).collect())) == sorted(map(tuple, docs.select(*own).collect()))


def test_pseudonymised_rows(spark, odd):
    rows = odd + [(600, "card 4041894974608795.", "en", "a"), (601, "pay 4041894974608795 now", "en", "b")]
    docs = frame(spark, rows)
    got = pseudonyms.pseudonymised(docs, b"key")
    assert got.columns == docs.columns + ["n_values"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[600].text[5:21] == by[601].text[4:20] != "4041894974608795" and by[600].n_values == 1
    assert Counter((r.doc_id, r.text) for r in got.collect() if not r.n_values) == Counter((i, t) for i, t, *_ in odd)
    assert pseudonyms.pseudonymised(frame(spark, []), b"key").count() == 0


@pytest.mark.parametrize("block", [40, 2000])
def test_packing_rows(spark, odd, block):
    rng = random.Random(6)
    rows = odd + [(700 + i, "stone " * rng.randrange(40), "en", "a") for i in range(150)]
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    pieces = tokens.token_pieces(frame(spark, rows), path, most=64, with_ids=True)
    packed = packing.pack_pieces(pieces, 64, block_items=block).collect()
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, tuple(ids[k:k + 64])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in packed) == want
    sequences = defaultdict(list)
    for r in packed:
        assert r.length == len(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in packed)
    assert len(sequences) <= -(-total // 64) * 1.03 + 2
    assert packing.pack_pieces(tokens.token_pieces(frame(spark, []), path)).count() == 0


def test_packed_sequences(spark):
    public = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, None)], "doc_id long, text string")
    packed = packing.pack_pieces(tokens.token_pieces(docs, public.path("word_bpe_49k.json"), with_ids=True), 4096)
    ids = packing.packed_sequences(packed).first().ids
    assert len(ids) == packed.agg(F.sum("length")).first()[0] and sorted(ids).count(1) == 3


def test_hot_group_of_near_copies(spark):
    """A group too large for pairs in the first rounds: pivots and merging must still join it whole."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        words[int(rng.integers(0, 120))] = f"u{k}"
        rows.append((k, " ".join(words), "en", "a"))
    got = neardup.near_classes(frame(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {150}


def test_mix_of_clashing_names_and_null_ids(spark):
    """Columns named like the operator's own are kept, and many rows without an id are spread over the buckets."""
    rows = [(None, f"one two three {i}", "en", "a") for i in range(10_000)] + [(1, "four five", "en", "b")]
    docs = frame(spark, rows).withColumns({c: F.lit(f"own {c}") for c in ("size", "_id", "_key", "_text_key", "_part", "_runs", "text_key")})
    found, spans = mixing.source_mix(docs)
    assert found.groupBy("row_bucket").count().agg(F.max("count")).first()[0] < 2_000
    mixed = mixing.mixed_documents(docs, found, spans)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.select("size", "_id", "_key", "_text_key", "_part", "_runs").distinct().collect()} == {
        tuple(f"own {c}" for c in ("size", "_id", "_key", "_text_key", "_part", "_runs"))}


def test_null_ids_are_not_held_out(spark, tmp_path):
    from factloom.llm.queries import QUERIES
    docs = spark.createDataFrame([(i if i else None, f"word {i % 7} the and {i}", "en" if i % 2 else "de", "s", 9) for i in range(60)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_language"](spark, str(tmp_path)).collect()
    assert [r.held_out for r in got if r.doc_id is None] == [False] and all(r.held_out is not None for r in got)
