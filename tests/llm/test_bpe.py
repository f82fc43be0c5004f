import hashlib
import random

import numpy as np
import pytest
import tiktoken

from spectroloom.llm import byte_bpe as B


@pytest.fixture(scope="module")
def ranks():
    return B.load_ranks()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks={p: i for i, p in enumerate(ranks.pieces)}, special_tokens={})


def slow(pieces, word):
    """The rule itself: the whole word, or else its leftmost pair of least rank, again and again."""
    if word in pieces:
        return [pieces[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while found := [(pieces[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in pieces]:
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [pieces[p] for p in parts]


def test_words_match_the_rule(ranks):
    g, pieces = random.Random(1), {p: i for i, p in enumerate(ranks.pieces)}
    words = ["a" * n for n in range(1, 40)] + ["ab" * 20, "aab" * 15, "abab" * 7 + "a", "the", " the", "ñ中文\U0001f600", "=" * 77, "x" + "-" * 50]
    words += ["".join(g.choice(("ab", "etain shr", "éüñ中", "01", "-=")[g.randrange(5)]) for _ in range(g.randrange(1, 60))) for _ in range(400)]
    words = list(dict.fromkeys(words))
    first, ids = B.Codec(ranks).encode([[w] for w in words])
    for k, w in enumerate(words):
        assert ids[first[k] : first[k + 1]].tolist() == slow(pieces, w.encode()), w


def test_merges_that_undercut_an_earlier_one():
    """A vocabulary where contracting all pairs of a rank at once would go wrong: 'ab' + 'cd' ranks below 'ab'."""
    pieces = [bytes([b]) for b in range(256)] + [b"cd", b"abcd", b"da", b"ab", b"abcdab", b"bcda"]
    ranks = B.Ranks(pieces, None, r"\S+|\s+", np.zeros(0, np.int64))
    table = {p: i for i, p in enumerate(pieces)}
    import pyarrow as pa

    rows = [(table[p[:i]], table[p[i:]], m) for p, m in table.items() for i in range(1, len(p)) if p[:i] in table and p[i:] in table]
    alone = {x for a, b, m in rows for x in (a, b) if x > 255 and m < x}
    assert alone
    a, b, m = np.array(rows, np.uint32).T
    ranks.pairs = pa.table({"pair": a * np.uint32(65536) + b, "merged": m.astype(np.int32), "alone": np.isin(m, sorted(alone)), "twin": a == b})
    g = random.Random(2)
    words = list({"".join(g.choice("abcd") for _ in range(g.randrange(2, 30))) for _ in range(500)})
    first, ids = B.Codec(ranks).encode([[w] for w in words])
    for k, w in enumerate(words):
        assert ids[first[k] : first[k + 1]].tolist() == slow(table, w.encode()), w


def test_texts_match_the_library(spark, docs, rows, library, monkeypatch):
    want = {r[0]: library.encode_ordinary(r[1] or "") for r in rows}
    encoded = B.encode(docs).persist()
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: bytes(r.data) for r in B.decode(encoded).collect()} == {r[0]: (r[1] or "").encode() for r in rows}
    found = B.round_trip(docs).collect()
    assert len(found) == len(rows) and all(r.round_trip for r in found)
    for r in found:
        assert r.n_tokens == len(want[r.doc_id]) and r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in found)


def test_pattern_as_in_the_library(ranks, library):
    """Spaces, ends, contractions, and characters that newer versions of Unicode call letters or numbers."""
    cutter = B.Cutter(ranks)
    marks = [chr(c) for c in (9, 10, 13, 0x1C, 0x1F, 0x85, 0xA0, 0x180E, 0x2003, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x558, 0x88F, 0x323B0, 0x11DE0, 0x1246F, 0x1F600, 0x301)]
    texts = [a + b + c for a in ("a", " ", "1", "!", "") for b in marks for c in ("b", " b", "  ", "\n", "2", "'s", "'S", "")] + ["I'll don't we've   x  \n\n y ", " ", "", "\r\n\t", "'re'", "a" * 3000]
    assert len(ranks.newer)
    for t in texts:
        cut = [w for part in cutter.words(t) for w in part]
        assert "".join(cut) == t
        assert [i for w in cut for i in library.encode_ordinary(w)] == library.encode_ordinary(t), t
        if any(c in t for c in (chr(0x558), chr(0x323B0), chr(0x11DE0))):  # no letter, so it stands apart from one
            assert not any(len(w.strip()) > 1 and w.strip()[-1] in "ab2" and ord(max(w)) > 0x500 for w in cut)


def test_long_text_in_parts(spark, library, monkeypatch):
    g = random.Random(3)
    text = " ".join("".join(g.choice("etaoin") for _ in range(g.randrange(1, 9))) for _ in range(3000)) + " " + "z" * 5000 + "é" * 999
    monkeypatch.setattr(B, "PART_WORDS", 500)
    monkeypatch.setattr(B, "PART_CHARS", 2000)
    monkeypatch.setattr(B, "KEPT_WORDS", 300)
    ranks = B.load_ranks()
    import pyarrow as pa

    codec, got = B.Codec(ranks), {}
    for rows, first, ids in B._encoded(codec, B.Cutter(ranks), pa.array([text, None, "x", text])):
        for k, row in enumerate(rows.tolist()):
            got.setdefault(row, []).extend(ids[first[k] : first[k + 1]].tolist())
    assert got[0] == got[3] == library.encode_ordinary(text) and got[1] == [] and got[2] == library.encode_ordinary("x")


def test_odd_rows_and_none(spark, odd_docs, no_docs):
    assert sorted(map(str, (r.doc_id for r in B.round_trip(odd_docs).collect()))) == sorted(map(str, (r.doc_id for r in odd_docs.collect())))
    assert B.round_trip(no_docs).collect() == [] and B.encode(no_docs).collect() == []
    with pytest.raises(Exception, match="vocabulary"):
        B.decode(spark.createDataFrame([(1, [70000])], "doc_id long, ids array<int>")).collect()
    assert B.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, bytearray()), (2, bytearray())]
