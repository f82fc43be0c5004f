"""Words that any polynomial hash modulo 2**64 takes for one: Thue-Morse words and their complements."""

import numpy as np
import pyarrow as pa
import pytest

from spectroloom.llm import pieces as P
from spectroloom.llm import textops as X
from spectroloom.llm.decontaminate import find_contamination
from spectroloom.llm.langid import fit_language_model, predict_language
from spectroloom.llm.license_scan import scan_licenses
from spectroloom.llm.minhash_dedup import near_duplicates
from spectroloom.llm.sentencepiece_codec import round_trip
from spectroloom.llm.substring_dedup import remove_repeats

SIZES = (256, 512, 1024, 2048, 4096)


def morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.fixture(scope="module")
def pair(spark):
    """Two texts of 24 words: at each place, words that only a sound hash tells apart."""
    texts = [" ".join(morse(SIZES[i % 5], *(ab if i % 2 else ab[::-1])) + f"{i // 5}" for i in range(24)) for ab in ("ab", "ba")]
    assert len(set(texts[0].split()) | set(texts[1].split())) == 48
    return spark.createDataFrame([(1, texts[0], "en", "s", 1), (2, texts[1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_words():
    words = [morse(n, *ab) for n in SIZES for ab in ("ab", "ba")] + ["a", "a\0", "\0a", "a\0\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "x" * 16, "x" * 17, "x" * 24]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    w = X.words(raw, np.array([0, len(raw)]), X.SPACED_WORDS, False)
    assert len(w.hashes) == len(set(words)) == len(np.unique(w.hashes))
    moved = np.frombuffer(("shift " + " ".join(words[::-1])).encode(), np.uint8)
    assert (X.words(moved, np.array([0, len(moved)]), X.SPACED_WORDS, False).hashes[1:][::-1] == w.hashes).all()


def test_units():
    words = [morse(n, *ab) for n in SIZES for ab in ("ab", "ba")]
    assert len(P.units(*X.text_buffer(pa.array([" ".join(words)]))).starts) == len(words)


def test_operators(spark, pair):
    assert [r.n_removed for r in remove_repeats(pair).orderBy("doc_id").collect()] == [0, 0]
    assert [r.component_id for r in near_duplicates(pair).orderBy("doc_id").collect()] == [1, 2]
    assert all(r.round_trip for r in round_trip(pair).collect())
    items = pair.where("doc_id = 1").selectExpr("doc_id AS item_id", "text")
    assert [r.contaminated for r in find_contamination(pair, items).orderBy("doc_id").collect()] == [True, False]
    assert [r.n_words for r in scan_licenses(pair).orderBy("doc_id").collect()] == [24, 24]
    model = fit_language_model(pair.union(spark.createDataFrame([(i, "plain words of a text here", "de", "s", 1) for i in range(20)], pair.schema)))
    both = {r.doc_id: r.score for r in predict_language(pair, model).collect()}
    alone = {r.doc_id: r.score for i in (1, 2) for r in predict_language(pair.where(f"doc_id = {i}"), model).collect()}
    assert both == alone
