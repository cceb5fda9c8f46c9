"""Structure repair of conversations: the cheapest edits that leave an optional system row and then user and assistant in turn.

A conversation is a graph without cycles: its nodes are (rows read, role of the last row written), its edges read a row, with or without an
insert before it. Every path weighs one whole number. Its high digits are the cost; below them every edit has a digit of fixed width
at its place in the path (Delete 1, Insert 2, Keep 3, Rerole 4, as their letters are ordered, and zeros after the end). The smallest number is
the cheapest path and, among equal costs, the one whose letters are least. No second rule decides anything. A path into a node ends with the
edit that read its last row, so of two paths into a node none is the beginning of the other, and the smaller one stays smaller
whatever follows: one number for each node is enough.

Rows are read in pieces of PIECE rows, whose numbers start again, so they stay short; the pieces are joined by the same minimum
from the last one to the first. Conversations above LONG rows are cut into segments that are worked on in different tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import SPACE, frozen, id_or_last, id_or_null, partitions

#: Rows of a piece, and rows of a conversation up to which one task reads it as a whole.
PIECE, LONG = 128, 10_000
#: Bits of an edit's digit.
BITS = 3
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = "\0DIKR"
COSTS = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: Nodes by the last role written: nothing yet, system, user, assistant; and the role that must come next.
EMPTY, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
NODES = (EMPTY, SYSTEM, USER, ASSISTANT)
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Edits after the last row: inserts until an assistant row ends the conversation.
CLOSING = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_KEYS = ["c", "turn", "role", "text"]
_HEAD = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _spaced(name: str) -> Column:
    """A column as text, null as one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after the standard damage, by the checksum of ``conv_id:turn``; nulls count as one space.

    Of 20 cases 0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, and 4 makes it a user's.
    """
    case = F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), case.alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("case") == 3, 2).otherwise(1)
    kept = marked.filter("case <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    return kept.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("col")


class Row:
    """What the edits need to know of a row: role initial, whether it must go, and what keeping it costs besides."""

    __slots__ = ("initial", "must_go", "extra")

    def __init__(self, initial: str, must_go: bool, truncated: bool):
        self.initial, self.must_go, self.extra = initial, must_go, int(truncated and not must_go)


def _edges(row: Row) -> list[tuple[str, int, str, int]]:
    """(from, edit, to, cost) for reading the row without an insert."""
    out = [(node, DELETE, node, COSTS[DELETE]) for node in NODES]
    if row.must_go:
        return out
    for node in NODES:
        wanted = NEXT[node]
        if row.initial == wanted:
            out.append((node, KEEP, wanted, COSTS[KEEP] + row.extra))
        out.append((node, REROLE, wanted, COSTS[REROLE] + row.extra))
    if row.initial == SYSTEM:
        out.append((EMPTY, KEEP, SYSTEM, COSTS[KEEP] + row.extra))
    return out


def piece_weights(rows: list[Row], start: str) -> dict[str, tuple[int, int]]:
    """Least weight of the paths from ``start`` over all rows, and its number of edits, by the node they end in."""
    # Two edits a row at most: a second insert in one place costs 4 and leads nowhere that is not reached for less.
    width = 2 * len(rows)
    high = BITS * width
    best = {start: (0, 0)}
    edges: dict[tuple, list] = {}
    for row in rows:
        kind = (row.initial, row.must_go, row.extra)
        if kind not in edges:
            edges[kind] = _edges(row)
        before: dict[str, list[tuple[int, int]]] = {node: [] for node in NODES}
        for node, (weight, k) in best.items():
            before[node].append((weight, k))
            inserted = weight + (COSTS[INSERT] << high) + (INSERT << (BITS * (width - 1 - k)))
            before[NEXT[node]].append((inserted, k + 1))
        best = {}
        for source, edit, target, cost in edges[kind]:
            for weight, k in before[source]:
                found = weight + (cost << high) + (edit << (BITS * (width - 1 - k)))
                if target not in best or found < best[target][0]:
                    best[target] = found, k + 1
    return best


def _letters(weight: int, edits: int, width: int) -> str:
    return "".join(LETTERS[(weight >> (BITS * (width - 1 - k))) & 7] for k in range(edits))


def piece_tables(rows: list[Row], starts: Iterable[str]) -> list[tuple[int, dict[str, dict[str, tuple[int, int]]]]]:
    """For each piece its number of rows, and its least weights from every node; from ``starts`` only for the first one."""
    pieces = [rows[at : at + PIECE] for at in range(0, len(rows), PIECE)]
    return [(len(p), {node: piece_weights(p, node) for node in (NODES if k else starts)}) for k, p in enumerate(pieces)]


def cheapest(tables: list, start: str, ends: dict[str, int]) -> tuple[int, str, str] | None:
    """Cost, letters and last node of the least path from ``start``; ``ends`` gives what follows a last node costs.

    None where no path ends in one of ``ends``.
    """
    after, way = dict(ends), []
    for n, table in reversed(tables):
        here, steps, width = {}, {}, 2 * n
        for node, found in table.items():
            # The letters of two ways differ before one of them ends: what follows the piece decides by its cost alone.
            options = [(weight + (after[to] << (BITS * width)), edits, to) for to, (weight, edits) in found.items() if to in after]
            if options:
                total, edits, to = min(options)
                here[node] = total >> (BITS * width)
                steps[node] = _letters(total, edits, width), to
        after = here
        way.append(steps)
    if start not in after:
        return None
    node, written = start, []
    for steps in reversed(way):
        letters, node = steps[node]
        written.append(letters)
    return after[start], "".join(written), node


def closing_costs() -> dict[str, int]:
    return {node: COSTS[INSERT] * n for node, n in CLOSING.items()}


def repair(rows: list[Row]) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a whole conversation."""
    cost, letters, node = cheapest(piece_tables(rows, [EMPTY]), EMPTY, closing_costs())
    return cost, letters + LETTERS[INSERT] * CLOSING[node]


def written_rows(audit: str, rows: Iterable[tuple[str, str]], node: str = EMPTY) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation: ``audit`` applied to the rows (role, text), from ``node`` on."""
    source = iter(rows)
    for letter in audit:
        if letter == "I":
            node = NEXT[node]
            yield NAMES[node], ""
            continue
        role, text = next(source)
        if letter == "D":
            continue
        node = role[:1] if letter == "K" else NEXT[node]
        yield (role if letter == "K" else NAMES[node]), text


def _illegal(initials: list[str]) -> int:
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))


def _keyed(rows: DataFrame) -> DataFrame:
    """c (conv_id, null last), turn, role, text, whether the text is blank, and whether its end is cut off."""
    c = id_or_last(F.col("conv_id")).alias("c")
    plain = rows.select(c, F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"))
    bare = F.rtrim("text", F.lit(SPACE))
    return plain.select("*", (bare == "").alias("bare"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))


def _repaired(rows: DataFrame) -> DataFrame:
    """Result rows of the conversations in ``rows``, each read by one task as a whole."""
    ordered = rows.repartition(F.col("c")).sortWithinPartitions("c", "turn", "role", "text")
    # A column of whole numbers with nulls would reach pandas as doubles.
    known = F.coalesce("turn", F.lit(0).cast("long")).alias("turn")
    ordered = ordered.select("c", known, F.col("turn").isNull().alias("no_turn"), "role", "text", "bare", "open")

    def solved(c: int, turns: list, told: list, cases: list) -> tuple:
        seen, facts = set(), []
        blank = duplicate = truncated = 0
        for (role, text), (bare, open_end) in zip(told, cases, strict=True):
            again = not bare and (role, text) in seen
            seen.add((role, text))
            blank += bare
            duplicate += again
            cut = open_end and not bare and not again
            truncated += cut
            facts.append(Row(role[:1], bare or again, cut))
        cost, audit = repair(facts)
        known = {turn for turn in turns if turn is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        whole = "\n".join(f"{role}:{text}" for role, text in written_rows(audit, told))
        digest = hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest()
        return c, gaps, blank, duplicate, truncated, _illegal([r[:1] for r, _ in told]), cost, audit, digest

    def run(batches):
        held: list = [None, [], [], []]
        for pdf in batches:
            out = []
            for c, turn, no_turn, role, text, bare, open_end in pdf.itertuples(index=False, name=None):
                if c != held[0]:
                    if held[1]:
                        out.append(solved(*held))
                    held = [c, [], [], []]
                held[1].append(None if no_turn else turn)
                held[2].append((role, text))
                held[3].append((bare, open_end))
            yield pd.DataFrame(out, columns=names)
        if held[1]:
            yield pd.DataFrame([solved(*held)], columns=names)

    schema = f"c long, gaps long, {_HEAD}, repaired_sha256 string"
    names = [part.split()[0] for part in schema.split(", ")]
    return ordered.mapInPandas(run, schema)


def _segments(rows: DataFrame) -> DataFrame:
    """Rows of long conversations in segments: equal rows as one with ``times``, ``again`` where an earlier turn has the same role and text.

    Segments are numbered in the order of turns, and ``at`` is the place of a row in its segment.
    """
    merged = frozen(rows.groupBy(*_KEYS).agg(F.count("*").alias("times"), F.first("bare").alias("bare"), F.first("open").alias("open")), "rows")
    said = merged.groupBy("c", "role", "text").agg(F.min(F.struct("turn")).alias("earliest")).toDF("c", "said_role", "said_text", "earliest")
    same = (merged["c"] == said["c"]) & (F.col("role") == F.col("said_role")) & (F.col("text") == F.col("said_text"))
    told = merged.join(said, same).select(
        merged["c"], "turn", "role", "text", "times", "bare", "open", (~F.col("turn").eqNullSafe(F.col("earliest.turn"))).alias("again")
    )
    told = frozen(told, "told")
    dealt = told.repartitionByRange(partitions(rows.sparkSession), *_KEYS).sortWithinPartitions(*_KEYS)

    def numbered(batches):
        segment, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            places = [pa.array(np.full(n, segment)), pa.array(np.arange(at, at + n))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *places], [*batch.schema.names, "segment", "at"])
            at += n

    kinds = "c long, turn long, role string, text string, times long, bare boolean, open boolean, again boolean, segment long, at long"
    return frozen(dealt.mapInArrow(numbered, kinds), "segments")


def _facts(pdf: pd.DataFrame) -> list[Row]:
    """Rows of a segment, in order; copies of a row must go."""
    out = []
    for role, bare, open_end, again, times in zip(pdf["role"], pdf["bare"], pdf["open"], pdf["again"], pdf["times"], strict=True):
        must = bool(bare or again)
        out.append(Row(role[:1], must, bool(open_end)))
        out += [Row(role[:1], True, False)] * (int(times) - 1)
    return out


def _long_repaired(rows: DataFrame) -> DataFrame:
    """As ``_repaired`` for conversations of any length: a task holds one segment, or the ways through all segments of a conversation."""
    cut = _segments(rows)

    def ways(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Least path of a segment for every first and last node, with its rank among the paths from that first node."""
        pdf = pdf.sort_values("at")
        tables, out = piece_tables(_facts(pdf), NODES), []
        for start in NODES:
            found = [(end, way) for end in NODES if (way := cheapest(tables, start, {end: 0})) is not None]
            for rank, (end, way) in enumerate(sorted(found, key=lambda f: f[1][1])):
                out.append((*key, start, end, way[0], rank, way[1]))
        return pd.DataFrame(out, columns=["c", "segment", "start", "end", "cost", "rank", "letters"])

    every = cut.groupBy("c", "segment").applyInPandas(ways, "c long, segment long, start string, end string, cost long, rank int, letters string")
    every = frozen(every, "ways")

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        """The way through all segments; a conversation has no more of them than there are partitions."""
        after, steps = closing_costs(), []
        for segment, part in sorted(pdf.groupby("segment"), reverse=True):
            here = {}
            for start, end, cost, rank in zip(part["start"], part["end"], part["cost"], part["rank"], strict=True):
                if end in after and (start not in here or (cost + after[end], rank) < here[start][:2]):
                    here[start] = cost + after[end], rank, end
            steps.append((segment, here))
            after = {node: found[0] for node, found in here.items()}
        node, out = EMPTY, []
        total = after[EMPTY]
        for segment, here in reversed(steps):
            out.append((int(pdf["c"].iloc[0]), segment, node, here[node][2], total))
            node = here[node][2]
        return pd.DataFrame(out, columns=["c", "segment", "start", "end", "total"])

    taken = every.drop("letters").groupBy("c").applyInPandas(chosen, "c long, segment long, start string, end string, total long")
    taken = frozen(taken.join(every.drop("cost", "rank"), ["c", "segment", "start", "end"]), "taken")

    def applied(key: tuple, told: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        """A segment's repaired lines in chunks, and what it adds to the figures."""
        told = told.sort_values("at")
        start, letters = way["start"].iloc[0], way["letters"].iloc[0]
        source = (pair for pair, n in zip(zip(told["role"], told["text"], strict=True), told["times"], strict=True) for _ in range(int(n)))
        lines = [f"{role}:{text}" for role, text in written_rows(letters, source, start)]
        chunks = ["\n".join(lines[k : k + PIECE]) for k in range(0, len(lines), PIECE)]
        return pd.DataFrame([(*key, k, chunk) for k, chunk in enumerate(chunks)], columns=["c", "segment", "k", "lines"])

    pieces = cut.groupBy("c", "segment").cogroup(taken.groupBy("c", "segment")).applyInPandas(
        applied, "c long, segment long, k long, lines string"
    )
    last = taken.groupBy("c").agg(F.max_by("end", "segment").alias("end"), F.first("total").alias("cost"))
    inserts = {SYSTEM: "user:\nassistant:", USER: "assistant:"}
    tail = last.select("c", F.lit((1 << 63) - 1).alias("segment"), F.lit(0).cast("long").alias("k"), _by_node(inserts).alias("lines"))
    ordered = pieces.unionByName(tail.filter("lines is not null")).repartition(F.col("c")).sortWithinPartitions("c", "segment", "k")

    def hashed(batches):
        # The lines of a conversation pass by one after the other; only the running hash is held.
        current, digest = None, None
        for pdf in batches:
            out = []
            for c, lines in zip(pdf["c"], pdf["lines"], strict=True):
                if c != current:
                    if current is not None:
                        out.append((current, digest.hexdigest()))
                    current, digest = c, hashlib.sha256(lines.encode("utf-8", "surrogatepass"))
                else:
                    digest.update(b"\n" + lines.encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(out, columns=["c", "repaired_sha256"])
        if current is not None:
            yield pd.DataFrame([(current, digest.hexdigest())], columns=["c", "repaired_sha256"])

    digests = ordered.mapInPandas(hashed, "c long, repaired_sha256 string")
    # The audit is one text of the result row: a letter for each edit, as the row has to hold it.
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "letters"))), lambda x: x["letters"]), "")
    audits = taken.groupBy("c").agg(listed.alias("audit")).join(last, "c")
    audits = audits.select("c", F.concat("audit", _by_node({SYSTEM: "II", USER: "I"}, "")).alias("audit"), "cost")
    fault = {
        "blank": F.sum(F.when(F.col("bare"), F.col("times")).otherwise(0)),
        "duplicate": F.sum(F.when(F.col("bare"), 0).otherwise(F.col("times") - (~F.col("again")).cast("long"))),
        "truncated": F.count_if(~F.col("bare") & ~F.col("again") & F.col("open")),
    }
    counted = cut.groupBy("c").agg(*[v.cast("long").alias(k) for k, v in fault.items()])
    turns = cut.groupBy("c", "turn").agg(F.lit(1).alias("one")).groupBy("c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    joined = counted.join(turns, "c").join(audits, "c").join(_long_illegal(cut), "c").join(digests, "c", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


def _by_node(values: dict[str, str], other: str | None = None) -> Column:
    out = F.lit(other).cast("string")
    for node, value in values.items():
        out = F.when(F.col("end") == node, value).otherwise(out)
    return out


def _long_illegal(cut: DataFrame) -> DataFrame:
    """(c, illegal) over all segments: pairs within each, and the pairs where one segment ends and the next begins."""

    def within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        initials = [role[:1] for role in pdf["role"]]
        copies = int(pdf["times"].sum()) - len(pdf)
        return pd.DataFrame([(*key, _illegal(initials) + copies, initials[0], initials[-1])], columns=["c", "segment", "n", "head", "tail"])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        seams = [x for pair in zip(pdf["head"], pdf["tail"], strict=True) for x in pair]
        joints = sum(_illegal(seams[k : k + 2]) for k in range(1, len(seams) - 1, 2))
        return pd.DataFrame([(int(pdf["c"].iloc[0]), int(pdf["n"].sum()) + joints)], columns=["c", "illegal"])

    parts = cut.groupBy("c", "segment").applyInPandas(within, "c long, segment long, n long, head string, tail string")
    return parts.groupBy("c").applyInPandas(across, "c long, illegal long")


def repair_conversations(rows: DataFrame, every: DataFrame | None = None, long: int = LONG) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text), and for each conv_id of ``every`` besides.

    conv_id, gaps (turns missing between the first and the last), blank, duplicate and truncated (rows by their first fault), illegal
    (neighbours whose role initials are not su, ua or au), cost and audit (the cheapest edits: D, I, K, R), and repaired_sha256 of the
    repaired ``role:text`` lines. Rows are taken by turn, nulls first, then by role and text. A null role or text is one space; rows
    without conv_id are one conversation, whose conv_id is null. Equal rows count as often as they occur. A conversation without rows has
    zeros, an empty audit and the hash of nothing. Conversations above ``long`` rows are cut into segments, with the same answer. Other
    columns are not read; an empty table gives an empty result.
    """
    keyed = _keyed(rows)
    sizes = keyed.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") > long).select("c")
    sizes = frozen(sizes, "long")
    if sizes.isEmpty():
        solved = _repaired(keyed)
    else:
        solved = _repaired(keyed.join(sizes, "c", "left_anti")).unionByName(_long_repaired(keyed.join(sizes, "c", "left_semi")))
    if every is not None:
        ids = every.select(id_or_last(F.col("conv_id")).alias("c")).distinct()
        solved = ids.join(solved, "c", "left")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return solved.select(
        id_or_null(F.col("c")).alias("conv_id"),
        *[F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name) for name in figures],
        *[F.coalesce(F.col(name), F.lit(value)).alias(name) for name, value in nothing.items()],
    )
