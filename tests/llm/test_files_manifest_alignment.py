"""Token files, the Merkle manifest and the alignment of tokenizers against plain versions of themselves."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import alignment, manifest, patched, vocab
from factloom.llm.common import fresh_folder
from factloom.llm.queries import tokenizer_path
from factloom.llm.vocab import BAD, SECOND, Both, ByteLevel, Pieces

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, _group string, _key string, "
          "root string, pairs string, size long, file string, _row int")
HOSTILE = ["  two  blanks ", " lead", "trail ", "a \n b", "\n\n x", "tab\tend\t", "<|endoftext|> in text", "x<|endoftext|>", "▁ ▁x", "a▁b", "é ñ ü  中文 字",
           "a b  c", "🙂🙂 🙂", "é ́", "᠎ x", "<s> </s> <0x41>", "\x00 \x1c\x1d", "   ", "\n", "a" * 3000, "ab" * 500 + " " + "é" * 700, "don't we'll 'tis 12,345.67"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 1, "x", "y", "z", "r", "p", 5, "f", 3) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    words = ["the", "sun", "over", "Hügel,", "12", "stone.", "l'été", "x_y", "(and", "moon)"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), "en", rng.choice("abbbbb")) for i in range(60)]
    rows += [(100 + i, t, None, "c") for i, t in enumerate(HOSTILE)]
    return rows + [(None, None, None, None), (None, "null id", "de", None), (3, "again", "de", "b"), (3, "again", "de", "b"), (200, "", "fr", "é"),
                   (201, None, "fr", "z"), (202, "word " * 30_000, "en", "b"), (-5, "negative\nid\n", "en", "b")]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50_257, 1 << 32])
@pytest.mark.parametrize("covered", [0.0, 0.9, 1.0])
def test_blocks_round_trip(n, top, covered):
    rng = np.random.default_rng(n + top % 97)
    ids = np.where(rng.random(n) < 0.9, rng.integers(0, max(1, top // 50), n), rng.integers(0, top, n)).astype("<u4")
    data, starts = patched.encode_blocks(ids, covered)
    assert len(starts) == -(-n // patched.BLOCK)
    if n:
        blocks = np.frombuffer(data, np.uint8)
        assert np.array_equal(patched.decode_blocks(blocks, starts)[:n], ids)
        some = starts[len(starts) // 2:]
        assert np.array_equal(patched.decode_blocks(blocks, some)[:n - len(starts) // 2 * 128], ids[len(starts) // 2 * 128:])


def test_exceptions_save_bytes():
    """With few large ids, patches need less than one width for all ids of a block, and than two bytes an id."""
    ids = np.random.default_rng(1).zipf(1.3, 20_000).clip(0, 50_256).astype("<u4")
    size = len(patched.encode_blocks(ids)[0])
    assert size < len(patched.encode_blocks(ids, 1.0)[0]) and size < 2 * len(ids)


def test_segments():
    keys, ids = ["a", None, "é", ""], [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 500, 1)]
    data = patched.segment(keys, ids) + b"\n" + patched.segment([], []) + b"\n" + patched.segment(["b"], [ids[0]]) + b"\n"
    parts = list(patched.segments(data))
    assert [p.keys for p in parts] == [keys, [], ["b"]] and parts[0].counts.tolist() == [3, 0, 500, 1]
    whole = np.frombuffer(b"".join(ids), "<u4")
    for first, last in [(0, 504), (2, 3), (127, 260), (500, 900), (5, 5)]:
        assert np.array_equal(parts[0].ids(first, last), whole[first:last])
    with pytest.raises(ValueError):
        list(patched.segments(b"x" * 64))


def test_token_files(spark, odd, monkeypatch):
    from tokenizers import Tokenizer
    path, tokenizer = fresh_folder(spark), Tokenizer.from_file(tokenizer_path(A))
    patched.write_token_files(frame(spark, odd).repartition(5), path, tokenizer_path(A))
    got = patched.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    expected = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in odd]
    assert sorted(((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got)) == sorted((i is not None, i or 0, e) for i, e in expected)
    assert [(r.doc_id is not None, r.doc_id) for r in got] == sorted([(r.doc_id is not None, r.doc_id) for r in got], key=lambda k: (k[0], k[1] or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    short = patched.read_token_files(spark, path).drop("file").orderBy("start").collect()
    assert [tuple(r) for r in short] == [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got]
    flat = [i for r in got for i in r.ids]
    for first, last in [(0, 10), (1000, 40_000), (len(flat) - 3, len(flat) + 50)]:
        found = {r.position: r.id for r in patched.id_range(spark, path, first, last).collect()}
        assert found == dict(enumerate(flat[first:last], first))


def test_token_files_empty(spark, odd):
    path = fresh_folder(spark)
    patched.write_token_files(frame(spark, odd).limit(0), path, tokenizer_path(A))
    assert patched.read_token_files(spark, path).count() == 0


def test_encoders_equal_whole_texts(odd):
    plain, special, pieces = ByteLevel(tokenizer_path(A), True), ByteLevel(tokenizer_path(A)), Pieces(tokenizer_path(B))
    rng = random.Random(2)
    signs = [" ", "  ", "\n", "a", "é", "中", "'s", "1", "▁", "<|endoftext|>", " ", "\t", "!", " ", "Word", "́"]
    texts = [t or "" for _, t, *_ in odd] + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    for t in texts:
        assert plain.ids(t) == plain.whole(t) and special.ids(t) == special.whole(t)
        found = np.frombuffer(pieces.ids(t), "<u4")
        whole = pieces.model.encode(t)
        spelt = b"".join(pieces.entries()[i] for i in whole) == b" " + t.encode()
        assert (not spelt and alignment.BAD in found) or found.tolist() == whole


class Noted(dict):
    """The byte alphabet, which notes what it is asked for."""

    def __getitem__(self, key):
        self.asked = getattr(self, "asked", set()) | {key}
        return super().__getitem__(key)


def test_plain_letters_go_to_the_merges_as_they_are():
    """Letters below 128 stand for their own bytes; only a blank and other letters are looked up."""
    for plain in (True, False):
        e = ByteLevel(tokenizer_path(A), plain)
        e.signs = Noted(e.signs)
        for t in ("Sun", "sun over Stone", "moon, sun.\nstone"):
            assert e.ids(t) == e.whole(t)
        assert e.signs.asked <= {32}
        for t in ("Hügel", "a Hügel für été"):
            assert e.ids(t) == e.whole(t)
        assert 0xc3 in e.signs.asked


class Counted:
    """A sentencepiece model that notes what it is called with."""

    def __init__(self, model):
        self.model, self.calls = model, []

    def encode(self, text, **more):
        self.calls.append(text)
        return self.model.encode(text, **more)


def test_both_sides_from_one_cache(odd, monkeypatch):
    """Ids of both sides are those of whole texts, also when the cache is full."""
    a, b = ByteLevel(tokenizer_path(A), True), Pieces(tokenizer_path(B))
    texts = [t for _, t, *_ in odd if t] + ["One two, three.\nFour", "çà et là, ×2 ªb Ωμέγα", "", "one two ones"]
    for size in (600_000, 7):
        monkeypatch.setattr(vocab, "CACHED_CHUNKS", size)
        both = Both(a, b)
        for part in (texts[:30], texts[30:], texts):
            for t, ids in zip(part, both.ids(part)):
                ids = np.frombuffer(ids, "<u4")
                assert ids[ids < SECOND].tobytes() == a.whole(" " + t)
                second, whole = ids[ids >= SECOND], np.frombuffer(b.checked(t), "<u4")
                assert (BAD in second and BAD in whole) or (second ^ np.uint32(SECOND)).tolist() == whole.tolist()
            assert len(both.later) <= size and len(both.first) <= size


def test_new_words_are_encoded_in_one_call(monkeypatch):
    b = Pieces(tokenizer_path(B))
    b.model = Counted(b.model)
    both = Both(ByteLevel(tokenizer_path(A), True), b)
    for _ in range(2):
        both.ids(["sun over moon", "moon over stone", "sun"])
    assert [sorted(c) for c in b.model.calls] == [["moon", "over", "stone", "sun"]]
    assert b.words(["sun", "Hügel"]) == [b.checked("sun"), b.checked("Hügel")] and b.words([]) == []
    monkeypatch.setattr(b, "_entries", [e + b"x" if e == b" sun" else e for e in b._entries])
    assert b.words(["sun", "moon"]) == [b.checked("sun"), b.checked("moon")] == [vocab.packed([BAD]), b.checked("moon")]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """(root, siblings before and after of every leaf)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k - k % fanout
            proofs[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1:first + fanout])))
        nodes, at = [sha(*nodes[k:k + fanout]) for k in range(0, len(nodes), fanout)], [k // fanout for k in at]
    return nodes[0], proofs


def manifest_rows(rows, fanout):
    groups = defaultdict(list)
    for i, t, g, s in rows:
        n = None if t is None else len(t)
        leaf = sha(*map(field, (i, s, g, n, t)))
        hit = i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and t is not None
        groups[s].append(((i is not None, i or 0, leaf), i, leaf, sha(*map(field, (i, s, g, n, t.replace("\n", "")))) if hit else leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort()
        trees[s] = tree([x[2] for x in groups[s]], fanout)
    root, tops = tree([trees[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        for (_, i, leaf, claim), proof in zip(groups[s], trees[s][1]):
            h = claim
            for b, a in proof + top:
                h = sha(b, h, a)
            out.append((i, leaf, trees[s][0], root, sha(*[b + a for b, a in proof + top]), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,levels", [(3, 1), (3, 7), (2, 2), (4, 1)])
def test_manifest(spark, odd, fanout, levels):
    rows = odd + [(1000 + i, f"hot\n{i}", "en", "hot") for i in range(150)]
    got = manifest.tamper_report(frame(spark, rows).repartition(6), fanout, levels).collect()
    assert sorted(map(tuple, got), key=str) == manifest_rows(rows, fanout)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28])
def test_manifest_of_small_sources(spark, n):
    rows = [(i, "t\n", "en", "a") for i in range(n)]
    got = manifest.tamper_report(frame(spark, rows), 3, 1).collect()
    assert sorted(map(tuple, got), key=str) == manifest_rows(rows, 3)


def test_manifest_empty(spark, odd):
    assert manifest.manifest(frame(spark, odd).limit(0)).count() == 0


def spans(ids, entries):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(entries[i]), i))
        at += len(entries[i])
    return out


def aligned(text, a, b):
    """(A ids, B ids) of each group, cut where tokens of both sides end."""
    if not text:
        return []
    full = (" " + text).encode()
    x, y = (spans(i, e.entries()) for i, e in ((a.tokenizer.encode(" " + text, add_special_tokens=False).ids, a), (b.model.encode(text), b)))
    if any(b"".join(e.entries()[i] for *_, i in s) != full for s, e in ((x, a), (y, b))):
        return []
    cuts = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
    return [([i for s, e, i in x if low <= s and e <= high], [i for s, e, i in y if low <= s and e <= high]) for low, high in zip([0] + cuts, cuts)]


def test_alignment(spark, odd):
    a, b = ByteLevel(tokenizer_path(A), True), Pieces(tokenizer_path(B))
    rows = [r for r in odd if r[0] != 202]
    rng = random.Random(3)
    rows += [(300 + i, "".join(rng.choice("abcé 中\n1▁") for _ in range(40)), "en", "a") for i in range(40)]
    groups = [aligned(t, a, b) for _, t, *_ in rows]
    links = [Counter((p, q) for g, h in gs for p in g for q in h) for gs in groups]
    documents = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (p, _), n in documents.items():
        best[p] = max(best[p], n)
    expected = []
    for (i, *_), gs, c in zip(rows, groups, links):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in gs)
        expected.append((i, sum(len(g) for g, _ in gs), sum(len(h) for _, h in gs), len(gs), sum(c.values()),
                         sum(n for k, n in c.items() if documents[k] == best[k[0]]), sum(n * documents[k] for k, n in c.items()),
                         sha(text) if gs else ""))
    got = alignment.link_report(frame(spark, rows).repartition(4), tokenizer_path(A), tokenizer_path(B)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    named = alignment.alignments(frame(spark, rows[:5]), tokenizer_path(A), tokenizer_path(B), with_groups=True).collect()
    for r, gs in zip(named, groups):
        assert r.groups == ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in gs) and r._text == "x"


def test_alignment_edges(spark, odd):
    empty = frame(spark, odd).limit(0)
    assert alignment.link_report(empty, tokenizer_path(A), tokenizer_path(B)).count() == 0
    long = alignment.link_report(frame(spark, [r for r in odd if r[0] == 202]), tokenizer_path(A), tokenizer_path(B)).first()
    assert long.n_a >= 30_000 and long.n_groups >= 30_000 and long.n_best > 0


def test_pointer_jumping_labels_components():
    rng = random.Random(7)
    for _ in range(300):
        total = rng.randrange(1, 40)
        ends = [np.array(sorted({*rng.sample(range(1, total + 1), rng.randrange(0, total)), total})) for _ in range(2)]
        a, b, n = alignment.group_numbers(*ends)
        cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert n == len(cuts) and a.tolist() == np.searchsorted(cuts, ends[0]).tolist() and b.tolist() == np.searchsorted(cuts, ends[1]).tolist()


def test_linked_ids_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    ga, gb = np.sort(rng.integers(0, 30, 200)), np.sort(np.append(rng.integers(0, 30, 170), np.arange(30)))
    ia, ib, owner = rng.integers(0, 6, 200), rng.integers(0, 6, 200), np.arange(30) // 7
    expected = Counter((int(owner[g]), int(i) << 32 | int(j)) for g, i in zip(ga, ia) for h, j in zip(gb, ib) if g == h)
    for cells in (3, 50, 1 << 22):
        monkeypatch.setattr(alignment, "GROUP_CELLS", cells)
        who, key, n = alignment.linked_ids(ga, ia, gb, ib, 30, owner)
        assert dict(zip(zip(who.tolist(), key.tolist()), n.tolist())) == expected


@pytest.mark.parametrize("links", [1, 3, 1 << 40])
@pytest.mark.parametrize("ids", [5, 1 << 17, 1 << 20])
def test_merged_links(links, ids):
    rng = np.random.default_rng(6)
    owner, a, b, n = rng.integers(0, 5, 400), rng.integers(ids - 5, ids, 400), rng.integers(ids - 5, ids, 400), rng.integers(1, links + 1, 400)
    expected = Counter()
    for o, i, j, m in zip(owner.tolist(), a.tolist(), b.tolist(), n.tolist()):
        expected[o, i << 32 | j] += m
    who, key, found = alignment._merged([(owner[:100], (a << 32 | b)[:100], n[:100]), (owner[100:], (a << 32 | b)[100:], n[100:])])
    assert list(zip(zip(who.tolist(), key.tolist()), found.tolist())) == sorted(expected.items())
