"""Each operator against a brute-force version, and on odd rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from array import array
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridelens.llm import byte_bpe, exact_dedup, imatch, language_id, licenses, mixing, ngram_join, token_counts, token_files, toxicity, words
from ridelens.llm.bpe import Ranks, read_ranks
from ridelens.llm.components import components
from ridelens.llm.shared import prepare, table, units
from ridelens.llm.wavelet import WaveletMatrix

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, suspect string, node long, block int"
WORDS = "the quick brown fox jumps over a lazy dog and then it sleeps for some hours in warm sun".split()
LETTERS = [*"ab 's't're\n\t  ' éÀ漢👍1٣!?\x1c\x85 Σ_\x00  ", "<|endoftext|>", "  ", "'ll", "the", "aaaa"]


@pytest.fixture(scope="module")
def session(spark):
    prepare(spark)
    return spark


def rows(session, *pairs):
    """Documents with extra columns of names the operators use themselves."""
    return session.createDataFrame([(i, t, "en", "s", 0, "x", "x", 7, 1) for i, t in pairs], SCHEMA)


def odd(session):
    long = " ".join(WORDS * 3000)
    return rows(
        session, (1, "Same text"), (2, "same TEXT"), (9, "sAME text"), (3, None), (4, ""), (5, long), (6, long + " end"),
        (7, "É same"), (8, "é same"), (None, "same text"), (2, "same TEXT"), (10, "!!! 123"), (11, " \n\t "),
    )


def some_texts(n=300, seed=1):
    r = random.Random(seed)
    return ["".join(r.choices(LETTERS, k=r.randrange(0, 50))) for _ in range(n)]


OPERATORS = {
    "op1": exact_dedup.exact_duplicates,
    "op2": token_counts.token_counts,
    "op3": lambda d: toxicity.toxicity(d, d.select("doc_id", F.lit(1).alias("toxic"))),
    "op4": lambda d: mixing.mixture(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "op5": lambda d: licenses.licences(d.select(F.col("doc_id").cast("string").alias("path"), "text")),
    "op6": token_files.token_files,
    "op7": ngram_join.near_duplicates,
    "op8": language_id.languages,
    "op9": imatch.fingerprints,
    "op10": byte_bpe.round_trip,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_odd_rows(session, name):
    docs = odd(session)
    assert OPERATORS[name](docs.limit(0)).count() == 0
    left_out = {"op7", "op9"}  # rows with a null id
    assert OPERATORS[name](docs).count() == docs.count() - (name in left_out)


# --- 1 --------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_code_is_undone(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n, dtype=np.uint64))
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, 1 << 40)) == values).all()


def test_exact_duplicates(session):
    docs = odd(session).repartition(5)
    got = exact_dedup.exact_duplicates(docs).collect()
    texts = [(r.doc_id, (r.text or "").encode().lower()) for r in docs.collect()]
    assert len(got) == len(texts)
    for r in got:
        digest = {t: hashlib.sha256(t).hexdigest() for _, t in texts}
        own = [i for i, t in texts if digest[t] == r.text_sha256]
        assert r.doc_id in own and r.group_size == len(own)
        assert r.keep_id == max((i for i in own if i is not None), default=None) and r.kept == (r.doc_id == r.keep_id)


# --- 2 and 10 -------------------------------------------------------------------------
def test_counts_are_the_librarys():
    counter = token_counts.Counter(public_tokenizers.path(token_counts.TOKENIZER), chunk=7)
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    for text in some_texts():
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_state_maps_compose_in_any_grouping():
    counter = token_counts.Counter(public_tokenizers.path(token_counts.TOKENIZER))
    text = "".join(some_texts(20, 5)).replace(token_counts.SPECIAL, "")
    a, b, c = (counter.state_map(text[i : i + len(text) // 3 + 1]) for i in range(0, len(text), len(text) // 3 + 1))
    assert counter.compose(counter.compose(a, b), c) == counter.compose(a, counter.compose(b, c))


@pytest.mark.parametrize("unit", ["aB3/x+Qz", "漢字仮名", "ab\n", "a", "=", "don't's'sé"])
def test_long_texts_without_a_space_hold_no_prefixes(unit):
    """Such texts are one map; only what is composed is kept, and counts stay the library's."""
    import tracemalloc

    path = public_tokenizers.path(token_counts.TOKENIZER)
    r, parts = random.Random(11), list(unit)
    text = "".join(r.choice(parts) for _ in range(60_000))
    counter = token_counts.Counter(path, chunk=100)
    counter.machine.most = 300  # states are dropped within a piece as well
    maps = [counter.state_map(text[i : i + 100]) for i in range(0, len(text), 100)]
    tracemalloc.start()
    head, inside, tail = counter.total(maps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(text)
    library = Tokenizer.from_file(path)
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert counter.tokens(head) + (inside or 0) + counter.tokens(tail) == counter.count(text)


def test_chunks_are_composed_without_prefixes(monkeypatch):
    """All maps together are composed from no more text than a balanced tree has."""
    counter = token_counts.Counter(public_tokenizers.path(token_counts.TOKENIZER), chunk=100)
    made, compose = [], counter.compose
    monkeypatch.setattr(counter, "compose", lambda a, b: made.append(compose(a, b)) or made[-1])
    assert counter.count("xyz" * 10_000) == token_counts.Counter(public_tokenizers.path(token_counts.TOKENIZER)).count("xyz" * 10_000)
    assert len(made) == 299 and sum(len(m[0]) for m in made) < 30_000 * 12


def test_bpe_is_the_librarys_and_comes_back():
    path = public_tokenizers.path(byte_bpe.TOKENIZER)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    own = byte_bpe.Encoder(path)
    for text in [*some_texts(), "a" * 5000]:
        ids = own.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("most", [800_000, 40])
def test_columns_are_encoded_by_different_units(most):
    """A unit of a column is matched once however often it stands there, and ids and bytes stay the library's."""
    path = public_tokenizers.path(byte_bpe.TOKENIZER)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    own = byte_bpe.ColumnEncoder(path, most)
    for column in (some_texts(), ["", " ", "a" * 5000, " a  b", "ab c\x1c d\x85 e"], [], some_texts(), ["once x10 once x10 once"]):
        ids, ends = own.column(pa.array(column, pa.string()))
        assert [list(memoryview(i).cast("I")) for i in byte_bpe.of_each(ids, ends)] == [library.encode_ordinary(t) for t in column]
        assert [bytes(d) for d in own.decode(ids, ends)] == [t.encode() for t in column]
    made, many = own.own.find, []
    own.own.find = lambda unit: many.append(unit) or made(unit)
    own.column(pa.array(["a new99 one", "a new99 one"] * 500))
    assert many.count(" new99") == 1


def test_shorter_tokens_are_tried_without_a_search():
    own = byte_bpe.Encoder(public_tokenizers.path(byte_bpe.TOKENIZER))
    r = random.Random(3)
    for token in r.sample(sorted(own.ids), 2000):
        begins = [own.ids.get(token[:n], byte_bpe.NONE) for n in range(1, len(token) + 1)]
        known = [i for i in begins[:-1] if i != byte_bpe.NONE]
        assert own.shorter[own.ids[token]] == (known[-1] if known else byte_bpe.NONE)
        for n in range(1, len(token) + 1):
            assert own.match[token[:n]] == [i for i in begins[:n] if i != byte_bpe.NONE][-1]


def test_neighbours_fit_as_merges_have_it():
    ranks = Ranks(read_ranks(public_tokenizers.path(byte_bpe.TOKENIZER)))
    r = random.Random(2)
    for _ in range(3000):
        a, b = r.randrange(len(ranks.ids)), r.randrange(len(ranks.ids))
        assert ranks.fits(a, b) == (ranks.merge(ranks.bytes_of[a] + ranks.bytes_of[b]) == [ranks.bytes_of[a], ranks.bytes_of[b]])


def test_units_join_to_the_text():
    for text in some_texts():
        assert " ".join(units(text)) == text


# --- 3 --------------------------------------------------------------------------------
def test_segments_are_maximal():
    r = np.random.default_rng(3)
    for _ in range(200):
        scores = r.integers(-4, 4, r.integers(1, 12)).astype(float)
        found = toxicity.segments(scores)
        assert found == sorted(found) and all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))
        assert _maximal(scores, 0, len(scores)) == [(a, b) for a, b, _ in found]


def _maximal(scores, low, high):
    """The best segment (the shortest of equals), then the same on either side."""
    spans = [(scores[a : b + 1].sum(), a - b, -a, a, b) for a in range(low, high) for b in range(a, high)]
    best = max(spans, default=(0,))
    if best[0] <= 0:
        return []
    *_, a, b = best
    return _maximal(scores, low, a) + [(a, b)] + _maximal(scores, b + 1, high)


def test_toxic_texts_are_found(session):
    r = random.Random(4)
    texts = [" ".join(r.choices(WORDS, k=60)) + (" you vile rotten creature" if i % 5 == 0 else "") for i in range(600)]
    docs = rows(session, *enumerate(texts))
    labels = session.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).where("held_out").collect()
    assert len(got) > 80 and all(g.predicted == int(g.doc_id % 5 == 0) and 0 <= g.score <= 1 for g in got)


def test_chance_features_are_not_kept(session):
    """Labels that say nothing: the level follows the number of features that are tested."""
    r = random.Random(14)
    texts = [(int(r.random() < 0.15), " ".join(f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(40))) for _ in range(1500)]
    data = session.createDataFrame(texts, "label int, text string")
    assert len(toxicity.log_odds(data)) <= 3
    marked = [(label, text + (" vile rotten" if label else "")) for label, text in texts]
    found = toxicity.log_odds(session.createDataFrame(marked, "label int, text string"))
    assert {f for w in ("vile", "rotten") for f in toxicity.features(w)} <= set(found) and len(found) <= 8


def test_chances_and_level_by_hand():
    # 2 of 4 texts are toxic; a feature in both toxic ones only: 1 of 6 ways, two tails.
    assert np.allclose(toxicity.chance_of(np.array([0, 1]), np.array([2, 1]), 2, 2), [1 / 3, 1.0])
    p, times = np.array([0.001, 0.01, 0.04, 0.9]), np.array([1, 1, 1, 7])
    assert toxicity.level(p, times, 0.05) == 0.01 and toxicity.level(p, times, 0.001) == 0.0


# --- 4 --------------------------------------------------------------------------------
def test_rates_reach_targets(session):
    r = random.Random(5)
    p = [[r.random(), r.random() / 4, r.random() / 9] for _ in range(500)]
    p = [[x / sum(q) for x in q] for q in p]
    members = session.createDataFrame([(i, 10 + i % 50, q) for i, q in enumerate(p)], "doc_id long, n_tokens long, p array<double>")
    targets = np.array([0.5, 0.3, 0.2])
    rate, shares = mixing.fit_rates(members, targets)
    rates = [x.rate for x in members.withColumn("rate", rate).collect()]
    assert np.abs(np.array(shares) - targets).max() < 0.02 and min(rates) >= 0 and max(rates) <= mixing.HIGHEST


@pytest.mark.parametrize(("common", "sure", "targets"), [(0.95, 1.0, [0.5, 0.5]), (0.95, 0.97, [0.5, 0.5]), (0.75, 0.75, [0.45, 0.55]), (0.999, 1.0, [0.9, 0.1])])
def test_rates_reach_far_targets(session, common, sure, targets):
    """Small domains that need many times their tokens, and blurred ones."""
    r = random.Random(6)
    p = [[q, 1 - q] for q in (sure if i < 2000 * common else 1 - sure for i in range(2000))]
    members = session.createDataFrame([(i, r.randrange(20, 60), q) for i, q in enumerate(p)], "doc_id long, n_tokens long, p array<double>")
    rate, shares = mixing.fit_rates(members, np.array(targets))
    reached = mixing.expected(members, 2, rate) / members.agg(F.sum("n_tokens")).first()[0]
    assert np.allclose(shares, reached) and np.abs(reached - targets).max() < 1e-3


def test_impossible_targets_give_the_nearest_shares(session):
    members = session.createDataFrame([(i, 10, [0.7, 0.3] if i % 2 else [0.4, 0.6]) for i in range(400)], "doc_id long, n_tokens long, p array<double>")
    rate, shares = mixing.fit_rates(members, np.array([0.1, 0.9]))
    rates = {tuple(x.p): x.rate for x in members.withColumn("rate", rate).collect()}
    # Of the nearest shares, c x (0.4, 0.6) from the second kind only: relative to own sizes 0.55 and 0.45.
    c = (0.1 * 0.4 / 0.55 + 0.9 * 0.6 / 0.45) / (0.4**2 / 0.55 + 0.6**2 / 0.45)
    assert rates[0.7, 0.3] == 0 and np.allclose(shares, [0.4 * c, 0.6 * c], atol=1e-3)


def test_mixture_tells_targets_and_shares(session):
    docs = odd(session)
    row = mixing.mixture(docs, docs.select("doc_id", F.lit(1).alias("quality"))).first()
    assert len(row.targets) == len(row.shares) == len(row.domains) and np.allclose(row.targets, row.shares, atol=1e-3)


# --- 5 --------------------------------------------------------------------------------
def test_licences_own_and_inherited(session):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/y.py", "Licensed under CC BY-NC 4.0.\ncode"),
        ("c/z.py", None), ("a/d/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/d/e/q", "x"),
    ]
    got = {r.path: (r.licence, r.how) for r in licenses.licences(session.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/b/x.py"] == ("MIT", "inherited") and got["a/b/y.py"] == ("CC-BY-NC-4.0", "own")
    assert got["a/d/e/q"] == ("GPL-3.0", "inherited") and got["c/z.py"] == (None, "none")


def test_licence_scores_are_those_of_all_sentences(session):
    """Sentences of random template terms and others: none that reaches the threshold is passed over."""
    r = random.Random(5)
    rows, idf, rare = licenses.template_weights()
    vectors: dict[int, dict[str, float]] = {}
    for i, _, term, weight in rows:
        vectors.setdefault(i, {})[term] = weight
    texts = []
    for _ in range(300):
        terms = list(vectors[r.randrange(len(vectors))])
        words = r.sample(terms, r.randint(1, len(terms))) + r.choices(["of", "other", "word"], k=r.randint(0, 3))
        r.shuffle(words)
        texts.append(" ".join(words))

    def best(text: str) -> float:
        counts = {t: text.split().count(t) for t in set(text.split())}
        weights = {t: n * idf.get(t, rare) for t, n in counts.items()}
        norm = sum(w * w for w in weights.values()) ** 0.5
        return max(round(sum(w * v.get(t, 0) for t, w in weights.items()) / norm, 6) for v in vectors.values())

    # Two texts to a path: the closer one counts, they are not read as one.
    files = [(f"p{i // 2}", text) for i, text in enumerate(texts)]
    got = {r.path: r.score for r in licenses.own_licences(session.createDataFrame(files, "path string, text string")).collect()}
    scores = {f"p{i}": max(best(texts[2 * i]), best(texts[2 * i + 1])) for i in range(len(texts) // 2)}
    want = {path: score for path, score in scores.items() if score >= licenses.THRESHOLD}
    assert 20 < len(want) < 150 and set(got) == set(want)
    assert all(abs(got[path] - want[path]) < 2e-6 for path in want)


# --- 6 --------------------------------------------------------------------------------
def test_wavelet_matrix():
    r = random.Random(6)
    ids = np.array([r.choice([1, 2, 3, 7, 49_000]) for _ in range(2500)], np.uint32)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.pack(ids, 16))
    assert (matrix.all() == ids).all() and all(matrix.access(i) == ids[i] for i in range(0, 2500, 61))
    for value in (1, 7, 49_000, 12):
        places = np.flatnonzero(ids == value)
        assert matrix.count(value, 1500) == (places < 1500).sum() and matrix.find(value, len(places)) == -1
        assert all(matrix.find(value, k) == places[k] for k in range(0, len(places), 40))


def test_files_hold_the_librarys_ids(session):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    texts = {i * 3: t for i, t in enumerate(some_texts(200, 8))}
    got = {r.doc_id: r for r in token_files.token_files(rows(session, *texts.items())).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(array("I", ids).tobytes())
        start += len(ids)


# --- 7 --------------------------------------------------------------------------------
def test_near_duplicates_are_all_found(session):
    r, texts = random.Random(9), {}
    for i in range(400):
        if i % 4 == 0:
            base = [f"w{r.randrange(500)}" for _ in range(r.randrange(3, 120))]
        words = list(base)
        for _ in range(i % 4):
            words[r.randrange(len(words))] = f"w{r.randrange(500)}"
        texts[i] = " ".join(words)
    texts |= {400: None, 401: "", 402: texts[0].upper()}
    got = {x.doc_id: x for x in ngram_join.near_duplicates(rows(session, *texts.items())).collect()}
    sets = {i: _shingles(t) for i, t in texts.items()}
    links, root = dict.fromkeys(texts, 0), {i: i for i in texts}
    different = {}
    for i, s in sets.items():
        different.setdefault(s, i)
    for a, b in combinations([s for s in different if s], 2):
        if len(a & b) >= 0.8 * len(a | b):
            for i, s in sets.items():
                links[i] += s in (a, b)
            old, new = root[different[a]], root[different[b]]
            root = {i: new if x == old else x for i, x in root.items()}
    for i, s in sets.items():
        cls = root[different[s]] if s else i
        members = [j for j, t in sets.items() if t and root[different[t]] == cls] if s else [i]
        assert (got[i].class_id, got[i].class_size, got[i].n_links) == (max(members), len(members), links[i])


def _shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def test_minhash_takes_no_large_memory():
    """Values of long sets are made in one small piece of memory, and are the least of each function."""
    import tracemalloc

    rows = np.random.default_rng(7).integers(0, 2**64, 5000, np.uint64)
    times, plus = ngram_join._FACTORS
    least = [int((rows * t + p).min()) >> 32 for t, p in zip(times, plus, strict=True)]
    tracemalloc.start()
    got = ngram_join.minhash(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == least and peak < 500_000


def test_sketches_by_hand():
    """Rows of five words are told apart, words that cannot be encoded count too, and only equal bands have equal keys."""
    assert len(words.shingles("a b c d e f a b c d e")) == 6 and len(words.shingles("A  b\x1cc")) == 1 and not len(words.shingles(" \t"))
    assert words.shingles("A b C").tolist() == words.shingles("a\nB c").tolist() != words.shingles("a c b").tolist()
    assert len(set(words.words("x \ud800 y \ud801 x").tolist())) == 4
    values = np.random.default_rng(8).integers(0, 2**32, (50, 200), np.uint32)
    values[1, 5:] = values[0, 5:]
    values[2] = np.tile(values[0, :5], 40)
    keys = ngram_join.band_keys(values)
    assert keys[0, 0] == keys[2, 0] and (keys[0, 1:] == keys[1, 1:]).all() and len(set(keys.ravel().tolist())) == 50 * 40 - 39 - 1
    texts = ["one two three four five six", None, " ", "ONE two three four five six", "", "seven"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([t or "" for t in texts])], ["doc_id", "text"])
    (made,) = ngram_join._sketch([batch])
    sets, bands = made.column(1).to_pylist(), made.column(2).to_pylist()
    assert sets[0] == sets[3] != sets[5] and bands[0] == bands[3] != bands[5]
    assert [s is None for s in sets] == [b is None for b in bands] == [False, True, True, False, True, False]
    assert [len(b) for b in bands if b] == [ngram_join.BANDS] * 3 and ngram_join._sketch([batch.slice(0, 0)]).__next__().num_rows == 0


def test_large_groups_are_compared_in_blocks(session, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    base = [f"w{i}" for i in range(300)]
    texts = {i: " ".join([*base, f"own{i}"]) for i in range(100)}
    got = ngram_join.near_duplicates(rows(session, *texts.items())).collect()
    assert all(g.class_id == 99 and g.n_links == 99 for g in got)


def test_repeated_rows_are_linked_once(session):
    base = [f"w{i}" for i in range(100)]
    texts = [(5, " ".join(base)), (5, " ".join(base)), (3, " ".join([*base, "more"]))]
    got = ngram_join.near_duplicates(rows(session, *texts)).collect()
    assert len(got) == 3 and all((g.class_id, g.n_links) == (5, 1) for g in got)


def test_components(session):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(components(session.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- 8 --------------------------------------------------------------------------------
def test_all_cuts_are_summed():
    pieces = {"": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "▁": 5}
    chances = np.array([[1e-6] * 2, [0.2, 0.1], [0.3, 0.2], [0.1, 0.4], [0.2, 0.1], [0.2, 0.2]])

    def brute(word, k):
        if not word:
            return 1.0
        return sum(chances[pieces.get(word[:n], 0), k] * brute(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in pieces or n == 1)

    words = ["ab", "abab", "ba", "x", "abx"]
    got = language_id.word_logs(words, chances, pieces)
    assert np.allclose(np.exp(got), [[brute("▁" + w, k) for k in (0, 1)] for w in words])
    counts = language_id.expected_counts(words, np.ones(len(words)), chances[:, 0], pieces)
    assert np.isclose(sum(counts[i] * max(len(p), 1) for p, i in pieces.items()), sum(len(w) + 1 for w in words))


def test_words_walk_the_trie_together():
    """Arcs are those that looking up every part of every word gives; parts of no piece are not looked up."""
    pieces = language_id.pieces_of(language_id.tokenizer_path(language_id.VOCABULARY))
    r, trie = random.Random(4), language_id.Trie(pieces.number)
    some = [p for p in pieces.number if p]
    words = ["".join(r.choices(some, k=3))[:9].ljust(9, "é") for _ in range(200)] + ["ქართულიaaa"[:9], "漢字仮名漢字仮名漢", "𐐨" * 9]
    walked, step = [], trie.step
    trie.step = lambda nodes, letters: walked.append(len(letters)) or step(nodes, letters)
    got = {(begin, to, i, piece) for begin, to, rows, ids in language_id.arcs(words, 9, trie) for i, piece in zip(rows.tolist(), ids.tolist(), strict=True)}
    parts = [(b, e, i, w[b:e]) for i, w in enumerate(words) for b in range(9) for e in range(b + 1, 10)]
    assert got == {(b, e, i, pieces.number.get(part, 0)) for b, e, i, part in parts if part in pieces.number or e == b + 1}
    assert sum(walked) < len(parts)


def test_languages_are_told(session):
    docs = table(session, SMALL, "documents")
    got = language_id.languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 0
    no_letters = language_id.languages(odd(session)).where("doc_id in (3, 4, 10, 11)").collect()
    assert [(r.lang_pred, r.score) for r in no_letters] == [("und", 0.0)] * 4


def test_languages_of_few_documents_are_learned(session):
    words = {"en": WORDS, "xx": ["zorb", "quil", "vint", "plax"]}
    r = random.Random(12)
    texts = [(i, " ".join(r.choices(words[lang], k=30)), lang) for i in range(4000) for lang in ("xx" if i % 500 == 7 else "en",)]
    docs = session.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language_id.fit(docs, rows=200)
    learned = docs.where(~language_id.held_out()).groupBy("lang").count().orderBy("lang").collect()
    assert model.languages == ["en", "xx"] == [x.lang for x in learned]
    n = np.array([x["count"] for x in learned])
    assert np.allclose(model.log_prior, np.log(n / n.sum()))
    path = language_id.tokenizer_path(language_id.VOCABULARY)
    assert [x for x, _ in language_id.Scorer(model, path).score(["zorb vint plax quil", " ".join(WORDS)])] == ["xx", "en"]


def test_quotas():
    assert language_id.quota([5, 1000, 1000], 1005) == 500 and language_id.quota([5, 6], 100) == language_id.LEAST
    assert language_id.quota([10**6] * 4, 10_000) == 2500 and language_id.quota([10**6] * 10**4, 10_000) == language_id.LEAST


# --- 9 --------------------------------------------------------------------------------
def test_fingerprints(session):
    r = random.Random(10)
    texts = {i * 5: " ".join(r.choices([f"t{k}" for k in range(400)], k=r.randrange(0, 80))) for i in range(150)}
    texts |= {3: texts[0], 4: "short"}
    got = {x.doc_id: x for x in imatch.fingerprints(rows(session, *texts.items())).collect()}
    order = sorted(texts, reverse=True)
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        text, n = texts[i], len(texts[i]) // 3
        changed = text[: len(text) - n] + texts[following][:n]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].near_next == imatch.likeness(got[i].fingerprint, got[following].fingerprint)
    assert got[3].fingerprint == got[0].fingerprint
    near = [got[i] for i in order if len(texts[i]) > 100]
    assert np.mean([x.near_edited for x in near]) > 0.15 + np.mean([x.near_next for x in near])


def _near_copies():
    """Common words, pairs of near copies by middling words, and a term of its own in every document."""
    r, texts = random.Random(13), {}
    for i in range(600):
        if i % 4 == 0:
            base = r.choices([f"m{k}" for k in range(3000)], k=60)
        texts[i] = " ".join([*WORDS, *base, f"own{i}x", f"id{i * 7919}"])
    return texts


def test_terms_of_few_documents_are_left_out(session):
    docs = rows(session, *_near_copies().items())
    got = {x.doc_id: x.fingerprint for x in imatch.fingerprints(docs).collect()}
    assert all(got[i] == got[i - i % 4] for i in got) and len(set(got.values())) == 150
    words = imatch.lexicon(docs)
    assert not imatch.among(imatch.terms("own5x the"), words.inside).any() and words.whole


@pytest.mark.parametrize("kept", [0, 700])
def test_joined_lexicon_gives_the_same(session, monkeypatch, kept):
    docs = rows(session, *_near_copies().items(), (9000, None), (9001, "only9 here9"), (3, "another text of the same id"))
    want = sorted(imatch.fingerprints(docs).collect())
    monkeypatch.setattr(imatch, "KEPT", kept)
    assert not imatch.lexicon(docs).whole and sorted(imatch.fingerprints(docs).collect()) == want


def _plain_terms(text):
    found = set(re.findall(r"\w+", text.lower()))
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


def test_terms_are_those_of_the_pattern():
    every = "".join(map(chr, range(0x110000)))
    odd_texts = [every, " ".join(every), "ΑΣ ΑΣ'Α İx_1 ﬁ ǅ", "a\x1cb\x85c\u200dd", "No_1 No_2", "", " ", "é", *some_texts()]
    for text in odd_texts:
        assert imatch.terms(text).tolist() == _plain_terms(text).tolist()


def test_terms_take_less_time_than_by_the_pattern():
    r = random.Random(14)
    texts = [" ".join(f"{a}{r.randrange(10**9)}" for _ in range(300)) + end for a, end in (("w", "."), ("ü", "。")) for _ in range(200)]

    def seconds(terms):
        start = time.process_time()
        for text in texts:
            terms(text)
        return time.process_time() - start

    assert min(seconds(imatch.terms) for _ in range(5)) < 0.85 * min(seconds(_plain_terms) for _ in range(5))


def _plain_fingerprint(text, band):
    """By whole numbers and without arrays: each lexicon's hash over its terms, ascending."""
    numbers = {xxhash.xxh3_64_intdigest(x) for x in re.findall(r"\w+", text.lower())}
    chosen, odd_number, wrap, parts = sorted(numbers & band or numbers), 0x9E3779B97F4A7C15, 1 << 64, []

    def mixed(x):
        x = (x ^ x >> 32) * odd_number % wrap
        return x ^ x >> 29

    for i in range(60):
        seed = mixed((i + 1) * odd_number % wrap)
        own = [x for x in chosen if mixed(x ^ seed) < wrap >> i // 6 + 1]
        digest = xxhash.xxh3_64_hexdigest(b"".join(x.to_bytes(8, "little") for x in own))
        parts.append(digest[:6] if own else "......")
    return "".join(parts)


def test_fingerprints_against_brute_force(session):
    r, texts = random.Random(15), {}
    for i in range(300):
        base = r.choices([f"{a}{k}" for a in ("M", "é", "漢_") for k in range(700)], k=r.randrange(60))
        texts[i * 7] = r.choice([" ", ", ", "\n"]).join([*WORDS[: i % 9], *base, f"own{i}"])
    texts |= {1: "", 2: "only here", 3: texts[700], 4: "!!! ?"}
    counts = Counter(x for t in texts.values() for x in set(re.findall(r"\w+", t.lower())))
    band = {xxhash.xxh3_64_intdigest(x) for x, n in counts.items() if 3 <= n <= 0.02 * len(texts)}
    got = {x.doc_id: x for x in imatch.fingerprints(rows(session, *texts.items())).collect()}
    order = sorted(texts, reverse=True)
    assert band and len(got) == len(texts)
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        changed = texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[following][: len(texts[i]) // 3]
        assert got[i].fingerprint == _plain_fingerprint(texts[i], band)
        assert got[i].edited_fingerprint == _plain_fingerprint(changed, band)
