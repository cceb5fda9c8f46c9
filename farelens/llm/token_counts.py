"""Token counts of whole texts by a compiled transducer; long texts in chunks whose maps compose in a parallel scan."""

from __future__ import annotations

import gc
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import frozen, partitions, whole_text
from farelens.llm.transducer import Transducer, from_json

#: UTF-8 bytes from which on a text is counted in chunks, and code points of a chunk.
LONG_BYTES, CHUNK_POINTS = 1 << 18, 1 << 16
#: Chunk maps that compose in one step of the scan.
FAN_IN = 64
# Before white space that follows something else every path is in a state that does not depend on what came earlier.
_SYNC = re.compile(r"(?<=[^\s])(?=[ \t\n])")


def chunk_map(text: str, machine: Transducer) -> tuple[str, int | None, str]:
    """State map of a chunk as (head, tokens, tail): whatever the state on entry, the machine synchronises after ``head``; from there
    to the start of ``tail`` it adds ``tokens``; ``tail`` is open at the end. A chunk that never synchronises is all head, tokens None.
    """
    first = _SYNC.search(text)
    if first is None:
        return text, None, ""
    last = first.start()
    for place in _SYNC.finditer(text, max(first.start(), len(text) - 1000)):
        last = place.start()
    return text[: first.start()], machine.count(text[first.start() : last]), text[last:]


def compose(left: tuple, right: tuple, machine: Transducer) -> tuple[str, int | None, str]:
    """Map of two neighbouring chunks; composition is associative."""
    if right[1] is None:
        return (left[0] + right[0], None, "") if left[1] is None else (left[0], left[1], left[2] + right[0])
    if left[1] is None:
        return left[0] + right[0], right[1], right[2]
    return left[0], left[1] + machine.count(left[2] + right[0]) + right[1], right[2]


def map_total(whole: tuple, machine: Transducer) -> int:
    """Tokens of a text from the map of all its chunks."""
    head, tokens, tail = whole
    return machine.count(head) if tokens is None else machine.count(head) + tokens + machine.count(tail)


_MAP = "row string, doc_id long, part long, parts long, head string, tokens long, tail string"


def _maps(batches, path: str):
    machine = from_json(path)
    for pdf in batches:
        found = [chunk_map(text, machine) for text in pdf.pop("text")]
        yield pdf.assign(
            head=[m[0] for m in found], tokens=pd.array([m[1] for m in found], "Int64"), tail=[m[2] for m in found]
        )


def _scan_step(pdf: pd.DataFrame, path: str) -> pd.DataFrame:
    """At most FAN_IN neighbouring maps of one text in one."""
    machine = from_json(path)
    pdf = pdf.sort_values("part")
    maps = [(h, None if pd.isna(n) else int(n), t) for h, n, t in zip(pdf["head"], pdf["tokens"], pdf["tail"], strict=True)]
    whole = maps[0]
    for one in maps[1:]:
        whole = compose(whole, one, machine)
    row = pdf.iloc[:1].copy()
    row["part"], row["parts"] = row["part"] // FAN_IN, -(-row["parts"] // FAN_IN)
    row["head"], row["tokens"], row["tail"] = whole[0], pd.array([whole[1]], "Int64"), whole[2]
    return row


def _long_counts(docs: DataFrame, path: str, points: int) -> DataFrame:
    """Counts of long texts. Chunks are dealt to all tasks; in each step of the scan, groups of FAN_IN neighbours compose."""

    def cut(batches):
        for pdf in batches:
            for row, doc_id, text in zip(pdf["row"], pdf["doc_id"], pdf["text"], strict=True):
                parts = -(-len(text) // points)
                for k in range(0, parts, 16):
                    own = range(k, min(k + 16, parts))
                    yield pd.DataFrame(
                        {
                            "row": row, "doc_id": pd.array([None if pd.isna(doc_id) else doc_id] * len(own), "Int64"),
                            "part": list(own), "parts": parts, "text": [text[p * points : (p + 1) * points] for p in own],
                        }
                    )

    spark = docs.sparkSession
    chunks = docs.mapInPandas(cut, "row string, doc_id long, part long, parts long, text string")
    maps = frozen(chunks.repartition(partitions(spark)).mapInPandas(lambda b: _maps(b, path), _MAP), "maps")
    most = maps.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        group = (F.col("part") / FAN_IN).cast("long").alias("group")
        maps = frozen(maps.groupBy("row", group).applyInPandas(lambda pdf: _scan_step(pdf, path), _MAP), "maps")
        most = -(-most // FAN_IN)

    def totals(batches):
        machine = from_json(path)
        for pdf in batches:
            whole = zip(pdf["head"], pdf["tokens"], pdf["tail"], strict=True)
            n = [map_total((h, None if pd.isna(k) else int(k), t), machine) for h, k, t in whole]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "row": pdf["row"]})

    return maps.mapInPandas(totals, "doc_id long, n_tokens long, row string")


def token_counts(docs: DataFrame, path: str, long_bytes: int = LONG_BYTES, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text, as the library counts them without added special tokens.

    The special string of the file counts as one token wherever it stands in a text. Null and empty texts have no tokens. A null
    doc_id stays null; every row of ``docs`` gives one row. Other columns are not read. ``path`` must be readable by the executors.
    """
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))

    def run(batches):
        machine = from_json(path)
        for pdf in batches:
            counts = [machine.count(text) for text in pdf["text"]]
            gc.freeze()  # the compiled tables are no garbage; they need not be looked through again
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": counts})

    size = F.octet_length("text").cast("long").alias("n_bytes")
    short = rows.filter(F.octet_length("text") <= long_bytes).select("*", size)
    counted = short.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    # The row name keeps rows of one doc_id apart; it holds the size, which the chunks do not.
    long = rows.filter(F.octet_length("text") > long_bytes)
    name = F.concat_ws("-", F.col("doc_id").cast("string"), F.octet_length("text"), F.uuid())
    named = frozen(long.select(name.alias("row"), "doc_id", "text"), "long-texts")
    sizes = named.select("row", F.octet_length("text").cast("long").alias("n_bytes"))
    counted_long = _long_counts(named, path, chunk_points).join(sizes, "row").select("doc_id", "n_bytes", "n_tokens")
    return counted.unionByName(counted_long)
