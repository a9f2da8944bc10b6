"""Hard negatives, packing and conversation repair against brute-force versions, and on odd rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridelens.llm import conversations, hard_negatives, packing, patterns, repair_dp
from ridelens.llm.queries import QUERIES
from ridelens.llm.shared import prepare, table
from ridelens.llm.strassen import product

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def session(spark):
    prepare(spark)
    return spark


# --- 11 -------------------------------------------------------------------------------
@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 18), (40, 64, 51), (3, 70, 90), (65, 65, 65)])
def test_products_are_exact(shape):
    r = np.random.default_rng(0)
    a, b = r.integers(-(1 << 25), 1 << 25, shape[:2]), r.integers(-(1 << 25), 1 << 25, shape[1:])
    assert (product(a, b) == a @ b).all()


def test_heaps_merge_in_any_order():
    r = random.Random(4)
    rows = [(r.randrange(5), r.randrange(8), i) for i in range(200)]
    want = sorted((k, -s, i) for k, s, i in rows)
    want = [x for n, x in enumerate(want) if sum(y[0] == x[0] for y in want[:n]) < 3]
    for cut in (1, 7, 50):
        r.shuffle(rows)
        heap = hard_negatives.Heap.empty(3)
        for i in range(0, len(rows), cut):
            heap.merge(*(np.array(c) for c in zip(*rows[i : i + cut], strict=True)))
        assert list(zip(heap.key, -heap.score, heap.vec_id, strict=True)) == want


def _mined(rows):
    """rows: id -> (label, whole-numbered vector)."""
    made = []
    for anchor, (label, own) in sorted(rows.items()):
        if anchor % 100:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(own, q, strict=True)), i) for i, (_, q) in rows.items() if i != anchor)
        for s, positive in [x for x in ranked if rows[x[1]][0] == label][:5]:
            fits = [(t, i) for t, i in ranked if rows[i][0] != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            made += [(anchor, positive, rank, i, -s, -t) for rank, (t, i) in enumerate(fits, 1)]
    return sorted(made)


def _mining_rows(n, seed=3):
    """Few different components, so that scores tie."""
    r = random.Random(seed)
    return [(i, [r.choice([0.25, 0.5, 0.5, -0.125]) for _ in range(6)], r.randrange(4), "x", 5) for i in range(n)]


MINING = "vec_id long, embedding array<float>, label int, tile string, part int"


def _as_contract(rows):
    return {i: ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in q]) for i, q, label, *_ in rows}


def test_hard_negatives_are_those_of_all_pairs(session, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 50)
    rows = _mining_rows(500)
    got = hard_negatives.hard_negatives(session.createDataFrame(rows, MINING).repartition(5)).collect()
    want = _mined(_as_contract(rows))
    assert want and sorted(map(tuple, got)) == want


def test_hard_negatives_of_odd_rows(session):
    rows = _mining_rows(250)
    nan, inf = float("nan"), float("inf")
    odd = [(1000, [nan] * 6, 1), (1001, [inf] * 6, 1), (1002, None, 1), (1003, [0.5] * 6, None), (1004, [0.5, None, 0.5, 0.5, 0.5, 0.5], 1), (None, [0.5] * 6, 1)]
    whole = rows + rows[::3] + [(*o, "y", 0) for o in odd]
    got = hard_negatives.hard_negatives(session.createDataFrame(whole, MINING)).collect()
    assert sorted(map(tuple, got)) == _mined(_as_contract(rows))
    assert hard_negatives.hard_negatives(session.createDataFrame([], MINING)).count() == 0
    short = [(0, [1.0, 0.5, 0.0], 1, "x", 0), (1, [1.0, 0.5], 1, "x", 0), (2, [1.0, 0.375], 2, "x", 0)]
    found = hard_negatives.hard_negatives(session.createDataFrame([(i + (i > 0) * 7, *r) for i, *r in short], MINING)).collect()
    assert [(r.positive_id, r.negative_id) for r in found] == []  # 0 becomes label 2: its one positive is 9
    with pytest.raises(Exception, match="too long"):
        hard_negatives.hard_negatives(session.createDataFrame([(1, [1e20] * 6, 1, "x", 0)], MINING)).count()


# --- 12 -------------------------------------------------------------------------------
TEXTS = ["", " ", "a  b", " a", "a ", "a\n b", "x <|endoftext|> y", "<|endoftext|>", "日本 語　 x", "don't  stop ", "a\x85 b", "tab\t x", "é è\x1c z", "<|endoftext|><|endoftext|> "]


def _library():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


@pytest.mark.parametrize("most", [40, 10_000])
def test_columns_are_encoded_as_by_the_library(most):
    r, library = random.Random(1), _library()
    encoder = packing.BatchEncoder(public_tokenizers.path(packing.TOKENIZER), most)
    assert len(encoder.column(pa.array([], pa.string()))[0]) == 0
    for _ in range(30):
        texts = ["".join(r.choices([*TEXTS, "the ", " cat", "\n", "s"], k=r.randrange(12))) for _ in range(r.randrange(1, 9))]
        ids, ends = encoder.column(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("lengths", [[], [1024] * 3, [700] * 5, [1] * 3000, [337] * 400 + list(range(1, 1024)), [512] * 7 + [511, 1], list(range(900, 1025)) * 3])
def test_plans_use_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=1025)
    made = patterns.plan(counts, 1024)
    used = Counter()
    for pattern, times in made:
        assert sum(pattern) <= 1024
        for n in pattern:
            used[n] += times
    assert used == Counter(lengths)
    slots = patterns.Slots(made)
    length = np.repeat(np.arange(1025), counts)
    rank = np.concatenate([np.arange(c) for c in counts]) if len(lengths) else np.zeros(0, int)
    sequence, offset = slots.of(length, rank)
    places = sorted(zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True))
    for (s, o, n), (t, p, _) in zip(places, [*places[1:], (-1, 0, 0)], strict=False):
        assert p == (o + n if s == t else 0)
    assert slots.n_sequences == len({s for s, _, _ in places})


def test_plans_need_few_sequences():
    r = np.random.default_rng(2)
    for lengths in (r.integers(1, 1025, 20_000), np.clip(r.geometric(1 / 300, 20_000), 1, 1024), np.r_[np.full(15_000, 337), r.integers(1, 1025, 5000)]):
        large = (lengths > 512).sum()
        least = max(-(-int(lengths.sum()) // 1024), int(large))
        assert sum(n for _, n in patterns.plan(np.bincount(lengths, minlength=1025), 1024)) <= 1.02 * least


def test_pieces_are_packed_without_gaps(session):
    docs = table(session, SMALL, "documents").select("doc_id", "text", F.lit("x").alias("ids"), F.lit(1).alias("part"))
    long = "word " * 5000
    extra = session.createDataFrame([(None, "null id"), (-1, None), (-2, ""), (-3, long), (-4, long), (-4, long), (-5, "a" * 90_000)], "doc_id long, text string")
    docs = docs.unionByName(extra.withColumns({"ids": F.lit("x"), "part": F.lit(1)})).repartition(5)
    library = _library()
    whole = defaultdict(list)
    for row in docs.collect():
        whole[row.doc_id].append(library.encode(row.text or "", add_special_tokens=False).ids + [packing.END])
    got = [r.asDict() for r in packing.packed(docs).collect()]
    sequences = defaultdict(list)
    copies = defaultdict(Counter)
    for r in got:
        ids = array("I", bytes(r["ids"])).tolist()
        assert len(ids) == r["length"] and ids == whole[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert r["piece"] == 0 or r["length"] == 1024
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        copies[r["doc_id"]][r["piece"]] += r["length"]
    for doc_id, own in whole.items():
        assert sum(copies[doc_id].values()) == sum(map(len, own)) and len(copies[doc_id]) == -(-len(own[0]) // 1024)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(x) for own in whole.values() for x in own)
    assert len(sequences) <= 1.05 * -(-total // 1024) + 1
    assert packing.packed(docs.limit(0)).count() == 0
    joined = packing.sequences(packing.packed(docs)).collect()
    assert sum(r.n_ids for r in joined) == total and all(len(r.ids) == 4 * r.n_ids for r in joined)


def test_packing_query_gives_checksums(session):
    library = _library()
    texts = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in table(session, SMALL, "documents").collect()}
    got = QUERIES["op12_packing"](session, SMALL).collect()
    assert {r.doc_id for r in got} == set(texts) and sum(r.length for r in got) == sum(map(len, texts.values()))
    for r in got:
        assert r.ids_crc32 == zlib.crc32(array("I", texts[r.doc_id][r.start : r.start + r.length]).tobytes())


# --- 13 -------------------------------------------------------------------------------
def _cheapest(symbols: str) -> tuple[int, str]:
    """Shortest paths over (rows read, state), by cost and then the string of edits."""
    waiting, settled = [(0, "", 0, 0)], {}
    while waiting:
        cost, edits, at, state = heapq.heappop(waiting)
        if at == len(symbols) and state in (0, 3):
            return cost, edits
        if settled.setdefault((at, state), (cost, edits)) != (cost, edits):
            continue
        then = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        heapq.heappush(waiting, (cost + 2, edits + "I", at, then))
        if at < len(symbols):
            symbol = symbols[at]
            heapq.heappush(waiting, (cost + 3, edits + "D", at + 1, state))
            if symbol != "x":
                extra = symbol.isupper()
                heapq.heappush(waiting, (cost + 2 + extra, edits + "R", at + 1, then))
                keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((symbol.lower(), state))
                if keep is not None:
                    heapq.heappush(waiting, (cost + extra, edits + "K", at + 1, keep))
    raise AssertionError


def test_edits_are_the_cheapest_and_least():
    r = random.Random(8)
    rows = ["", *("".join(r.choices("ssuuaaoSUAOx", k=r.randrange(1, 40))) for _ in range(400)), *("".join(r.choices("ua", k=300)) for _ in range(3))]
    rows += ["ua" * 500, "u" * 257, "x" * 100, "s" * 33]
    for row, matrix in zip(rows, repair_dp.matrices(rows), strict=True):
        assert repair_dp.best([matrix]) == _cheapest(row), row
    for row in rows[-20:]:
        parts = [row[i : i + 13] for i in range(0, len(row), 13)]
        assert repair_dp.best(repair_dp.matrices(parts) if parts else []) == _cheapest(row)


def test_grammar_is_undone():
    rows = ["uaua", "suauaua", "", "u", "aaaaaaa", "suaxuaua"]
    short, rules = repair_dp.compress(rows)
    def spelled(s):
        return "".join(spelled(rules[c]) if c in rules else c for c in s)
    assert [spelled(s) for s in short] == rows and rules
    assert all(len(right) == 2 for right in rules.values())


def test_shared_ropes_are_compared_by_letters():
    a = repair_dp.joined("K" * 60, "D" * 60)
    assert repair_dp.less((a, "D"), (a, "K")) and not repair_dp.less((a, "K"), (a, "D")) and not repair_dp.less(a, a)
    assert repair_dp.less(("KD", ("K", "I" * 70)), "KDKK") and repair_dp.text((a, "x")) == "K" * 60 + "D" * 60 + "x"


def _repaired(rows):
    """All conversations by brute force, in the words of the contract."""
    whole = defaultdict(list)
    for conv, turn, role, text in rows:
        own = whole[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    made = {}
    for conv, own in whole.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] if r[0] is None else hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, counts, symbols = set(), Counter(), ""
        for _, role, text in own:
            stripped = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = _cheapest(symbols)
        state, at, lines = 0, 0, []
        for edit in audit:
            role, text = own[at][1:] if edit != "I" else ("", "")
            at += edit != "I"
            if edit == "D":
                continue
            state = {"s": 1, "u": 2, "a": 3}[role[0]] if edit == "K" else {2: 3}.get(state, 2)
            lines.append(f"{role if edit == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        made[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return made


CONVERSATIONS = "conv_id long, turn long, role string, text string, digest string, copies int"


@pytest.mark.parametrize("block", [3, 4096])
def test_repairs_are_those_of_brute_force(session, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    r = random.Random(block)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "No", "", " \n", None, "Why? ", "So!\x0b", "A. b\x85", "é.", "long. " * 900]
    rows = [(c, t if r.random() < 0.95 else None, r.choice(roles), r.choice(texts)) for c in [None, *range(150)] for t in r.sample(range(-3, 20), r.randrange(1, 18))]
    gone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Dropped.")]
    rows += [(500, t, "user" if t % 2 else "assistant", f"Row {t}.") for t in range(300)] + rows[:40]
    df = session.createDataFrame([(*x, "z", 9) for x in rows], CONVERSATIONS).repartition(6)
    got = {x.conv_id: tuple(x)[1:] for x in conversations.repairs(df).collect()}
    want = _repaired(rows)
    assert set(got) == set(want) and want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert {c: x for c, x in got.items() if x != want[c]} == {}
    assert conversations.repairs(df.limit(0)).count() == 0


def test_repaired_rows_follow_the_grammar(session):
    rows = table(session, SMALL, "conversations")
    for damage in (True, False):
        own = defaultdict(list)
        for x in conversations.repaired(rows, damage).collect():
            own[x.conv_id].append((x.place, x.role, x.text))
        assert own
        for found in own.values():
            assert [p for p, _, _ in sorted(found)] == list(range(len(found)))
            assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in sorted(found)))


def test_repair_query_is_brute_force(session):
    rows = [tuple(x) for x in table(session, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {x.conv_id: tuple(x)[1:] for x in QUERIES["op13_conversation_repair"](session, SMALL).collect()}
    assert got == _repaired(rows)
