"""Model responses: JSON text in, reasoning and answer out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens import fixed_values as fixed
from farelens.functions import preview_text, strip_text

# Response forms. In the first, reasoning has a field of its own or stands in think tags; in the second
# it stands in think tags or after the word for "reasoning" up to the next heading.
REASONING_FIELD = "reasoning_field"
TAGGED_TEXT = "tagged_text"

_MESSAGE = "$.choices[0].message"
_TOKENS = "$.usage.completion_tokens_details.reasoning_tokens"


def _at(path: str, kind: str = "variant") -> Column:
    """Field of the parsed response ``_json``; null where there is none or it is of another kind."""
    return F.try_variant_get("_json", path, kind)


def _has(path: str) -> Column:
    """True when the field is there, even with a null value."""
    return _at(path).isNotNull()


def _after(text: Column, position: Column) -> Column:
    """Text from a position on."""
    return F.substring(text, position, F.length(text))


def parse_responses(df: DataFrame, mode: str = REASONING_FIELD) -> DataFrame:
    """Reasoning, answer and reasoning tokens of each ``response_json``.

    Errors and empty responses give a fixed answer and no reasoning. Of think tags, the first opening and
    the first closing one count; the stretch between them is cut from the answer.
    """
    if mode not in (REASONING_FIELD, TAGGED_TEXT):
        raise ValueError(f"unknown response form: {mode}")
    by_field = mode == REASONING_FIELD
    # Parsed once; a text that is no JSON has no fields.
    parsed = df.withColumn("_json", F.try_parse_json("response_json"))
    has_field = _has(f"{_MESSAGE}.reasoning_content") if by_field else F.lit(False)
    first = _at("$.choices[0]")
    fields = parsed.withColumns(
        {
            "_error": _has("$.error"),
            "_choices": first.isNotNull() & ~F.coalesce(F.is_variant_null(first), F.lit(True)),
            "_has_content": _has(f"{_MESSAGE}.content"),
            "_content": _at(f"{_MESSAGE}.content", "string"),
            "_has_field": has_field,
        }
    )

    content = F.col("_content")
    opened = F.locate(fixed.THINK_OPEN, content)
    closed = F.locate(fixed.THINK_CLOSE, content)
    inside = opened + F.lit(len(fixed.THINK_OPEN))
    tagged = ~F.col("_has_field") & (opened > 0) & (closed > 0)
    think = F.substring(content, inside, F.greatest(closed - inside, F.lit(0)))
    rest = F.concat(
        F.substring(content, F.lit(1), opened - F.lit(1)),
        _after(content, closed + F.lit(len(fixed.THINK_CLOSE))),
    )

    reasoning = F.when(tagged, strip_text(think))
    if by_field:
        given = _at(f"{_MESSAGE}.reasoning_content", "string")
        reasoning = F.when(F.col("_has_field"), given).otherwise(reasoning)
    else:
        word_at = F.locate(fixed.REASONING_WORD, content)
        tail = _after(content, word_at + F.lit(len(fixed.REASONING_WORD)))
        heading = F.locate("#", tail)
        # A heading right after the word leaves no reasoning.
        by_word = F.when(
            (word_at > 0) & (heading > 1),
            strip_text(F.substring(tail, F.lit(1), heading - F.lit(1))),
        )
        reasoning = F.when(tagged, strip_text(think)).otherwise(by_word)

    usable = ~F.col("_error") & F.col("_choices")
    answer = F.when(
        F.col("_error"),
        F.concat(F.lit(fixed.ERROR_PREFIX), F.coalesce(_at("$.error", "string"), F.lit("None"))),
    ).when(
        ~F.col("_choices"), F.lit(fixed.NO_CHOICES_SHORT if by_field else fixed.NO_CHOICES_LONG)
    )
    if not by_field:
        answer = answer.when(~F.col("_has_content"), F.lit(fixed.NO_CONTENT))
    answer = answer.when(tagged, strip_text(rest)).otherwise(strip_text(content))

    return fields.withColumns(
        {
            "reasoning": F.when(usable, reasoning),
            "answer": answer,
            "reasoning_tokens": _at(_TOKENS, "long"),
        }
    ).drop("_json", "_error", "_choices", "_has_content", "_content", "_has_field")


def reasoning_tokens(json: Column) -> Column:
    """Number of reasoning tokens that the response text reports, null without."""
    return F.try_variant_get(F.try_parse_json(json), _TOKENS, "long")


def answer_preview(df: DataFrame) -> DataFrame:
    """Short forms of question (50 characters, always dotted) and answer (100 characters)."""
    return df.withColumns(
        {
            "query_preview": F.concat(F.substring("query", 1, 50), F.lit("...")),
            "answer_preview": preview_text(F.col("answer"), 100),
        }
    )


def results_table(responses: DataFrame) -> DataFrame:
    """One row per question; of repeated questions the last response (by ``seq``) counts."""
    kept = F.struct("reasoning", "answer", "response_json")
    return responses.groupBy("query").agg(F.max_by(kept, "seq").alias("kept")).select(
        "query", "kept.*"
    )
