"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted texts.

Documents are packed where they are read, without a shuffle, and the packs are written in buckets. Each pack asks for its distinct
n-grams once; counts, contexts and requests meet in joins that are sharded by n-gram, and the answers of a pack go back to the bucket that
holds it, where they sum to a perplexity for each document; texts never travel. Thresholds are quantiles of trusted documents of a
language that the model has not seen.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import discard, discard_since, frozen, id_or_last, id_or_null, whole_text, written

ORDER = 5
#: UTF-8 bytes of text in a pack, about; a longer text is a pack by itself.
PACK_BYTES = 4 << 20
#: Parts of the n-grams in which packs ask, at least; above, packs for each part.
PARTS, PART_PACKS = 256, 8
#: Share of a language's trusted documents, as far as left out of training, that the threshold keeps.
KEEP = 0.99
#: One trusted document in so many is left out of training and sets the thresholds.
HELD_OUT = 5
#: Level of compression of a pack.
PACK_LEVEL = 6
BEGIN, END = "\x02", "\x03"
_SPACES, _DIGITS = re.compile(r"\s+"), re.compile(r"\d")


def normal(text: str) -> str:
    """Lower case, white space as single blanks, every digit as 0."""
    return _DIGITS.sub("0", _SPACES.sub(" ", text.lower()))


def _grams(texts: list[str], order: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts, their hashes in order, the number of each position's n-gram, and the first position of each text.

    A text counts len + 1 positions: its characters after order - 1 begin marks, and an end mark. Positions are numbered by a hash table;
    only the distinct n-grams, a small part of them, are sorted.
    """
    padded = [BEGIN * (order - 1) + text + END for text in texts]
    whole = "".join(padded)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(lengths)
    valid = np.ones(len(codes), bool)
    for k in range(1, order):
        valid[ends - k] = False
    at = np.flatnonzero(valid)
    windows = max(len(codes) - order + 1, 0)
    key = np.zeros(windows, np.uint64)
    for k in range(order):
        key ^= codes[k : k + windows]
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    met, hashes = pd.factorize(key[at])
    # Numbers are given in the order met, so an n-gram's first position is where the largest number so far grows.
    first = np.flatnonzero(np.diff(np.maximum.accumulate(met), prepend=-1))
    by_hash = np.argsort(hashes)
    rank = np.empty_like(by_hash)
    rank[by_hash] = np.arange(len(by_hash))
    grams = [whole[p : p + order] for p in at[first[by_hash]].tolist()]
    return grams, hashes[by_hash], rank[met], np.concatenate([[0], np.cumsum(lengths - order + 1)[:-1]]).astype(np.int64)


def _packs(docs: DataFrame) -> DataFrame:
    """Rows (batch, blob) and, for finding documents in them, (b, pos) lists: documents in the order read, compressed."""

    def pack(held):
        table = pa.table({c: pa.array([row[k] for row in held], t) for k, (c, t) in enumerate(fields)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", PACK_LEVEL))) as writer:
            writer.write_table(table)
        return uuid.uuid4().int >> 65, sink.getvalue().to_pybytes(), [row[0] for row in held]

    fields = (("b", pa.int64()), ("lang", pa.string()), ("text", pa.large_string()))

    def run(batches):
        held, size = [], 0
        for pdf in batches:
            for row in zip(pdf["b"].tolist(), pdf["lang"].tolist(), map(normal, pdf["text"]), strict=True):
                held.append(row)
                size += len(row[2].encode("utf-8", "surrogatepass"))
                if size >= PACK_BYTES:
                    yield pd.DataFrame([pack(held)], columns=["batch", "blob", "ids"])
                    held, size = [], 0
        if held:
            yield pd.DataFrame([pack(held)], columns=["batch", "blob", "ids"])

    rows = docs.select(id_or_last(F.col("doc_id")).alias("b"), F.col("lang").cast("string").alias("lang"), whole_text().alias("text"))
    return rows.mapInPandas(run, "batch long, blob binary, ids array<long>")


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _trusted_counts(packs: DataFrame, trusted: DataFrame, order: int) -> DataFrame:
    """(gram, c): counts over the trusted texts; the counts of a pack are summed before they are shuffled."""
    places = packs.select("batch", F.posexplode("ids").alias("pos", "b"))
    chosen = places.join(trusted, "b", "left_semi").groupBy("batch").agg(F.collect_list("pos").alias("chosen"))
    chosen = frozen(chosen, "trusted")

    def run(batches):
        for pdf in batches:
            for blob, keep in zip(pdf["blob"], pdf["chosen"], strict=True):
                texts = _unpacked(blob)["text"].take(pa.array(np.sort(keep))).to_pylist()
                grams, _, number, _ = _grams(texts, order)
                yield pd.DataFrame({"gram": grams, "c": np.bincount(number, minlength=len(grams))})

    rows = packs.select("batch", "blob").join(chosen, "batch").select("blob", "chosen")
    return rows.mapInPandas(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    row = counts.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [row[f"n{k}"] for k in (1, 2, 3, 4)]
    if not all(n[:3]):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) for k in range(3)]


def _by_count(values: list[float]) -> Column:
    return F.when(F.col("c") == 1, values[0]).when(F.col("c") == 2, values[1]).otherwise(values[2])


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame], float]:
    """Model of (gram, c): for each length 1 … order (gram, p), for each context length (context, gamma), and p of an unseen character.

    Shorter n-grams count the different characters before them. Each length has its three discounts, and shares what they leave
    by the distribution of the next shorter length; single characters share theirs evenly, an unseen one included.
    """
    by_length = {order: counts}
    for k in range(order - 1, 0, -1):
        longer = by_length[k + 1]
        by_length[k] = frozen(longer.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), f"counts-{k}")
    probabilities, gammas, unseen = [], [], 1.0
    for k in range(1, order + 1):
        own = by_length[k]
        discount = _by_count(_discounts(own))
        rows = own.select("gram", "c", F.substring("gram", 1, k - 1).alias("context"), discount.alias("d"))
        taken = F.sum(F.least("d", F.col("c").cast("double"))).alias("left")
        contexts = rows.groupBy("context").agg(F.sum("c").alias("total"), taken, F.count("*").alias("kinds"))
        contexts = frozen(contexts.withColumn("gamma", F.col("left") / F.col("total")), f"contexts-{k}")
        share = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        joined = rows.join(contexts, "context")
        if k == 1:
            top = contexts.first()
            unseen = top["gamma"] / (top["kinds"] + 1) if top else 1.0
            found = joined.select("gram", (share + unseen).alias("p"))
        else:
            shorter = probabilities[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            found = joined.withColumn("suffix", F.substring("gram", 2, k - 1)).join(shorter, "suffix")
            found = found.select("gram", (share + F.col("gamma") * F.col("q")).alias("p"))
        probabilities.append(frozen(found, f"model-{k}"))
        gammas.append(contexts.select("context", "gamma"))
    return probabilities, gammas, unseen


def _answered(wanted: DataFrame, model: tuple[list[DataFrame], list[DataFrame], float], order: int) -> DataFrame:
    """``wanted`` (gram and other columns) with p: the n-gram's own probability, or what its context leaves times that of its suffix."""
    probabilities, gammas, unseen = model
    by_length = {order: wanted}
    for k in range(order - 1, 0, -1):
        by_length[k] = by_length[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct()
    shorter, before = None, None
    for k in range(1, order + 1):
        names = by_length[k].columns
        rows = by_length[k].join(probabilities[k - 1], "gram", "left")
        if k == 1:
            found = rows.select(*names, F.coalesce("p", F.lit(unseen)).alias("p"))
        else:
            rows = rows.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("suffix", F.substring("gram", 2, k - 1))
            rows = rows.join(gammas[k - 1], "context", "left").join(shorter, "suffix")
            found = rows.select(*names, F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p"))
        found = frozen(found, f"answers-{k}")
        if before is not None:
            discard(before)
        before = found
        shorter = found.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
    return found


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """b (doc_id, null last), lang, n_chars (of the normalised text) and perplexity of every row; ``trusted``: column b."""
    before = written()
    packs = frozen(_packs(docs), "packs", by="batch")
    counts = frozen(_trusted_counts(packs, trusted, order), "counts")
    model = kneser_ney(counts, order)

    n = max(PARTS, packs.count() // PART_PACKS)

    def parted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the n-grams by part, the parts, and where each part starts."""
        part = (hashes % np.uint64(n)).astype(np.int32)
        by_part = np.argsort(part, kind="stable")
        parts, starts = np.unique(part[by_part], return_index=True)
        return by_part, parts, starts

    def ask(batches):
        for pdf in batches:
            for batch, blob in zip(pdf["batch"], pdf["blob"], strict=True):
                grams, hashes, _, _ = _grams(_unpacked(blob)["text"].to_pylist(), order)
                by_part, parts, starts = parted(hashes)
                joined = ["".join([grams[k] for k in held]) for held in np.split(by_part.tolist(), starts[1:])]
                yield pd.DataFrame({"batch": batch, "part": parts, "grams": joined})

    def cut(joined: str) -> list[str]:
        return [joined[k : k + order] for k in range(0, len(joined), order)]

    def once(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"gram": list({g for joined in pdf["grams"] for g in cut(joined)})}).assign(part=pdf["part"].iat[0])

    def reply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(right["gram"], right["lp"], strict=True))
        lp = [np.array([of[g] for g in cut(joined)], np.float32).tobytes() for joined in left["grams"]]
        return pd.DataFrame({"batch": left["batch"], "part": left["part"], "lp": lp})

    # A row asks for all n-grams of a pack that fall into a part, and is answered by as many numbers in the same order.
    asked = frozen(packs.select("batch", "blob").mapInPandas(ask, "batch long, part int, grams string"), "asked")
    wanted = frozen(asked.groupBy("part").applyInPandas(once, "gram string, part int"), "wanted")
    answers = _answered(wanted, model, order).select("part", "gram", F.log("p").alias("lp"))
    meet = asked.groupBy("part").cogroup(answers.groupBy("part"))
    replies = frozen(meet.applyInPandas(reply, "batch long, part int, lp binary"), "replies")
    discard_since(before, packs, replies)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = [pd.DataFrame({"b": [], "lang": [], "n_chars": [], "perplexity": []})]
        of = dict(zip(right["part"], right["lp"], strict=True))
        for blob in left["blob"]:
            table = _unpacked(blob)
            texts = table["text"].to_pylist()
            _, hashes, number, first = _grams(texts, order)
            by_part, parts, _ = parted(hashes)
            lp = np.zeros(len(hashes))
            lp[by_part] = np.frombuffer(b"".join([of[k] for k in parts.tolist()]), np.float32)
            sums = np.add.reduceat(lp[number], first)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            made.append(pd.DataFrame({"b": table["b"].to_pandas(), "lang": table["lang"].to_pylist(), "n_chars": size,
                                      "perplexity": np.exp(np.minimum(-sums / (size + 1), 700.0))}))
        return pd.concat(made[1:] or made)

    pairs = packs.select("batch", "blob").groupBy("batch").cogroup(replies.groupBy("batch"))
    found = frozen(pairs.applyInPandas(score, "b long, lang string, n_chars long, perplexity double"), "perplexities")
    discard_since(before, found)
    return found


def trusted_documents(labels: DataFrame, held_out: int = HELD_OUT) -> tuple[DataFrame, DataFrame]:
    """Column b of the trusted documents that train the model, and of those that set the thresholds."""
    trusted = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("b")).distinct()
    left_out = F.pmod(F.xxhash64("b", F.lit("threshold")), F.lit(held_out)) == 0
    return trusted.filter(~left_out), trusted.filter(left_out)


def quality_filter(docs: DataFrame, labels: DataFrame, order: int = ORDER, keep: float = KEEP, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold and kept of every row of ``docs``.

    Trusted are the documents that ``labels`` gives quality 1. A hash of doc_id leaves one in ``held_out`` of them out of training. A language's
    threshold is the ``keep`` quantile of its trusted documents left out (a sketch of relative accuracy 1/10000), which the model knows
    no better than any other good text; a language without any, null included, takes that of all trusted documents left out; without
    any there is no threshold and everything is kept. A null text is empty and has one position, the end. A null doc_id comes
    after all others and is not trusted. Rows that repeat are scored each. Only doc_id, text and lang are read.
    """
    training, measuring = trusted_documents(labels, held_out)
    scored = perplexities(docs, training, order)
    good = scored.join(measuring, "b", "left_semi")
    cut = F.percentile_approx("perplexity", F.lit(keep), F.lit(10_000))
    by_lang = frozen(good.groupBy("lang").agg(cut.alias("own")), "thresholds")
    every = good.agg(cut.alias("all")).first()["all"]
    both = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["lang"]), "left").drop(by_lang["lang"])
    threshold = F.coalesce("own", F.lit(every).cast("double"))
    return both.select(
        id_or_null(F.col("b")).alias("doc_id"), "lang", "n_chars", "perplexity", threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"),
    )
