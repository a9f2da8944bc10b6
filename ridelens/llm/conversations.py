"""Conversations damaged and repaired: the cheapest edits that give them a proper order of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm import repair_dp
from ridelens.llm.shared import stored

BLOCK = 4096  # rows of a conversation whose symbols stand in one string
SPACE = " \t\n\x0b\f\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `copies`, how often the damaged row is there: none, once or twice.

    Null roles and texts, and null ids and turns in what is hashed, are one space.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copies"))


def _order() -> list[Column]:
    """Rows of a conversation by turn, nulls first; rows of one turn by role and text. A text
    is only carried where turns are null; else its digest decides, which keeps copies together."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("tie"), F.asc("digest")]


def _ordered(rows: DataFrame) -> DataFrame:
    """Adds what rows are sorted and compared by."""
    whole = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumns({"digest": F.unhex(F.sha2(whole.cast("binary"), 256)), "tie": F.when(F.col("turn").isNull(), F.col("text"))})


def _times(copies: Column) -> Column:
    return F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")


def blocks(rows: DataFrame) -> DataFrame:
    """Damaged rows as symbols: one row for each BLOCK rows of a conversation, with counts of what was found in it.

    All windows share one shuffle by conversation, in which texts stay behind. A
    conversation of any length is sorted and read as a stream; a row that was dropped
    stands last, without a symbol, so that its conversation is known.
    """
    kept = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = _ordered(rows).select(
        "conv_id", (F.col("copies") == 0).alias("gone"), "turn", "role", "tie", "digest",
        (kept == "").alias("is_blank"), (~F.right(kept, F.lit(1)).isin(*".!?")).alias("is_cut"), _times(F.greatest("copies", F.lit(1))),
    )
    own = Window.partitionBy("conv_id").orderBy("gone", *_order())
    same = Window.partitionBy("conv_id", "gone", "digest").orderBy(*_order())
    here, initial = ~F.col("gone"), F.substr("role", F.lit(1), F.lit(1))
    first_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before.turn"))
    seen = (
        narrow.repartition("conv_id")
        .withColumns({"at": F.row_number().over(own) - 1, "before": F.lag(F.struct("turn", initial.alias("initial"))).over(own)})
        .withColumn("is_copy", F.row_number().over(same) > 1)
    )
    blank, copy = here & F.col("is_blank"), here & ~F.col("is_blank") & F.col("is_copy")
    cut = here & ~F.col("is_blank") & ~F.col("is_copy") & F.col("is_cut")
    pair = F.concat("before.initial", initial)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(~here, "").when(blank | copy, "x").when(cut, F.upper(letter)).otherwise(letter)
    marked = seen.select(
        "conv_id", "at", F.floor(F.col("at") / BLOCK).alias("block"), symbol.alias("symbol"), blank.alias("blank"), copy.alias("duplicate"), cut.alias("truncated"),
        (here & F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"), (here & first_turn).alias("new_turn"), F.when(here, F.col("turn")).alias("turn"),
    )
    symbols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "")
    counted = [F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    return marked.groupBy("conv_id", "block").agg(
        symbols.alias("symbols"), *counted, F.count_if("new_turn").alias("turns"), F.min("turn").alias("least"), F.max("turn").alias("most")
    )


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of different strings of symbols; those of a batch share one grammar."""
    for batch in batches:
        strings = batch.column(0).to_pylist()
        entries = [[e or (-1, "") for row in matrix for e in row] for matrix in repair_dp.matrices(strings)] if strings else []
        yield pa.RecordBatch.from_pydict({
            "symbols": pa.array(strings, pa.string()),
            "costs": pa.array([[cost for cost, _ in one] for one in entries], pa.list_(pa.int64())),
            "edits": pa.array([[repair_dp.text(rope) for _, rope in one] for one in entries], pa.list_(pa.string())),
        })


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its blocks, which come in order."""
    made: list[dict] = []
    state: dict | None = None

    def end(state: dict) -> dict:
        cost, audit = repair_dp.ended(state["row"])
        gaps = 0 if state["least"] is None else state["most"] - state["least"] + 1 - state["turns"]
        return {"conv_id": state["conv_id"], "gaps": gaps, "cost": cost, "audit": audit, **{c: state[c] for c in COUNTS[1:5]}}

    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] == 0:
                made += [end(state)] if state else []
                state = {"conv_id": row["conv_id"], "row": repair_dp.BEGIN, "least": None, "most": None} | dict.fromkeys((*COUNTS[1:5], "turns"), 0)
            for c in (*COUNTS[1:5], "turns"):
                state[c] += row[c]
            for c, choose in (("least", min), ("most", max)):
                state[c] = choose([v for v in (state[c], row[c]) if v is not None], default=None)
            flat = [None if cost < 0 else (cost, edits) for cost, edits in zip(row["costs"], row["edits"], strict=True)]
            state["row"] = repair_dp.times(state["row"], [flat[i : i + repair_dp.STATES] for i in range(0, len(flat), repair_dp.STATES)])
        yield pa.RecordBatch.from_pylist(made, schema=schema)
        made = []
    if state:
        yield pa.RecordBatch.from_pylist([end(state)], schema=schema)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, the counts, cost and audit of every conversation of damaged rows.

    Each different string of symbols is solved once, whatever the number of
    conversations that have it.
    """
    cut = stored(blocks(rows), "blocks")
    solved = stored(cut.select("symbols").distinct().mapInArrow(_solve, "symbols string, costs array<long>, edits array<string>"), "edits")
    parts = cut.join(solved, "symbols").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return parts.select("conv_id", "block", *COUNTS[1:5], "turns", "least", "most", "costs", "edits").mapInArrow(_compose, f"conv_id long, {counts}, audit string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row of the audit, None) for each conversation, then (that row, (role, text)) for each of its repaired rows."""
    head, edits, at, state = None, "", 0, repair_dp.START
    names = (None, None, "user", "assistant")

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            at, state = at + 1, repair_dp.FORCED[state]
            yield head, (names[state], "")

    for batch in batches:
        for row in batch.to_pylist():
            if row["is_head"]:
                yield from inserted()
                head, edits, at, state = row, row["audit"], 0, repair_dp.START
                yield head, None
                continue
            yield from inserted()
            edit, at = edits[at], at + 1
            if edit == "R":
                state = repair_dp.FORCED[state]
                yield head, (names[state], row["text"])
            elif edit == "K":
                state = repair_dp.KEPT[row["role"][:1]][state]
                yield head, (row["role"], row["text"])
    yield from inserted()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    made: list[dict] = []
    digest, empty = None, True
    for head, row in _edited(batches):
        if row is None:
            if made:
                made[-1]["repaired_sha256"] = digest.hexdigest()
            if len(made) >= 1000:
                yield pa.RecordBatch.from_pylist(made, schema=schema)
                made = []
            made.append({name: head[name] for name in schema.names[:-1]})
            digest, empty = hashlib.sha256(), True
        else:
            digest.update(f"{'' if empty else chr(10)}{row[0]}:{row[1]}".encode())
            empty = False
    if made:
        made[-1]["repaired_sha256"] = digest.hexdigest()
        yield pa.RecordBatch.from_pylist(made, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    made: list[dict] = []
    place = 0
    for head, row in _edited(batches):
        if row is None:
            place = 0
            continue
        made.append({"conv_id": head["conv_id"], "place": place, "role": row[0], "text": row[1]})
        place += 1
        if len(made) >= 1000:
            yield pa.RecordBatch.from_pylist(made, schema=schema)
            made = []
    yield pa.RecordBatch.from_pylist(made, schema=schema)


def _with_audits(rows: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order. Texts are shuffled this once."""
    found = stored(audits(rows), "audits")
    nothing = F.lit(None)
    heads = found.select(
        "conv_id", F.lit(True).alias("is_head"), nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("string").alias("tie"),
        nothing.cast("binary").alias("digest"), nothing.cast("string").alias("text"), *COUNTS, "audit",
    )
    texts = _ordered(rows).where("copies > 0").select(
        "conv_id", F.lit(False).alias("is_head"), "turn", "role", "tie", "digest", "text", *(nothing.cast("long").alias(c) for c in COUNTS),
        nothing.cast("string").alias("audit"), _times(F.col("copies")),
    )
    return heads.unionByName(texts.drop("copy")).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("is_head"), *_order())


def _typed(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))


def repairs(conversations: DataFrame) -> DataFrame:
    """Of every conversation after damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    A null conv_id is a conversation of its own. Repeated rows are rows: the later ones
    are duplicates. Rows of one turn stand by role, then by text (where turns are null)
    or its digest. A conversation all of whose rows are dropped has zeros, an empty
    audit and the digest of the empty text; no rows give no conversations. Other columns
    are left out. The digest reads a conversation's rows as a stream, in any number.
    """
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return _with_audits(damaged(_typed(conversations))).mapInArrow(_digests, f"conv_id long, {counts}, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, place, role and text of the repaired rows; ``damage=False`` repairs rows as they are."""
    rows = _typed(conversations)
    rows = damaged(rows) if damage else rows.na.fill(" ", ["role", "text"]).withColumn("copies", F.lit(1))
    return _with_audits(rows).mapInArrow(_rows, "conv_id long, place long, role string, text string")
