"""Chat formatting by prefix-target expansion.

A turn is written ``### role: text</turn>`` and a line end.  Inside roles and
texts a backslash stands before each backslash and before the control strings
``###`` and ``</turn>`` (in roles before ``:`` too), which is reversible.  Each
assistant turn becomes an example of its own: all preceding turns as context
and a loss span over that reply's text only.  A conversation that doesn't end
with an assistant turn gets one more example without a loss span, so that no
turn is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, ddl, fields, rows
from .store import width
from .tables import table

HEAD, END = "### ", "</turn>\n"
TRAINED = "assistant"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_EXAMPLES = fields(conv_id="long", example="long", n_turns="long", text="string", loss_start="long", loss_end="long")
_DIGEST = fields(conv_id="long", n_turns="long", turns_sha256="string", loss_chars="long", loss_sha256="string", formatted_chars="long")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text; raises if it isn't one."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


_NEW = object()


def _expand(arriving: Iterable) -> Iterator:
    """Turns sorted by conversation: one example for each assistant turn."""

    def examples():
        conv, text, n, k, tail = _NEW, "", 0, 0, False
        for conv_id, _, role, said in rows(arriving):
            if conv is _NEW or conv_id != conv:
                if tail:
                    yield conv, k, n, text, None, None
                conv, text, n, k, tail = conv_id, "", 0, 0, False
            role, said = role or "", escape(said or "")
            text += f"{HEAD}{escape_role(role)}: {said}{END}"
            n, tail = n + 1, role != TRAINED
            if not tail:
                end = len(text) - len(END)
                yield conv, k, n, text, end - len(said), end
                k += 1
        if tail:
            yield conv, k, n, text, None, None

    yield from batches(examples(), _EXAMPLES)


def prefix_examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, text, loss_start, loss_end (code points).

    Turns are ordered by turn, then role, then text, so ties and repeated rows
    have one order and are all kept.  Null roles and texts are empty; turns
    without a number come first; turns without a conv_id form one conversation.
    Other columns are not read.  A conversation is built in one task, from its
    turns in order: memory is that of its longest example, and its examples
    together are as long as the square of its turns, which is what the method
    asks for.  Very long texts are kept whole.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    dealt = own.repartition(width(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_expand, ddl(_EXAMPLES))


def _read_back(arriving: Iterable) -> Iterator:
    """Digests of each conversation from its examples alone."""

    def digest(conv, text, loss, loss_chars, chars):
        turns = parse(text)
        whole = hashlib.sha256()
        for role, said in turns:
            whole.update(f"{role}\n{said}\n".encode())
        return conv, len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars

    def found():
        conv, text, loss, loss_chars, chars = _NEW, "", None, 0, 0
        for conv_id, _, _, example, start, end in rows(arriving, 64):
            if conv is _NEW or conv_id != conv:
                if conv is not _NEW:
                    yield digest(conv, text, loss, loss_chars, chars)
                conv, loss, loss_chars, chars = conv_id, hashlib.sha256(), 0, 0
            text, chars = example, chars + len(example)  # the last example holds all turns
            if start is not None:
                said = unescape(example[start:end])
                loss.update(said.encode())
                loss_chars += len(said)
        if conv is not _NEW:
            yield digest(conv, text, loss, loss_chars, chars)

    yield from batches(found(), _DIGEST)


def digests(examples: DataFrame) -> DataFrame:
    """Reads prefix_examples() back; its rows come grouped and in order."""
    return examples.mapInArrow(_read_back, ddl(_DIGEST))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok', CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) x(i)),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))
    + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) + 14 AS own,
  row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)),
u AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM u GROUP BY 1
"""


def op3_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return digests(prefix_examples(turns.unionByName(probe)))
