"""Chat formatting with typed content parts.

A conversation becomes one string: ``<turn ROLE>CONTENT</turn>`` for each turn. In
roles and texts ``\\``, ``<`` and ``>`` are escaped by a backslash, so no text can
hold a mark of the template, and reading back gives the texts exactly. A visitor
flattens a turn's parts in order: text is escaped, an image, audio or document part
becomes a placeholder ``<KIND N>`` with the number of its attachment, whose reference
and expanded token count are recorded; a part of any other kind becomes ``<other N>`` and
is recorded under its own kind with no tokens. The loss mask covers what the trained roles say.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.runs import runs

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<number:int,kind:string,uri:string,tokens:bigint>"
_MARK = re.compile(r"\\(.)|<turn ((?:[^\\<>]|\\.)*)>|(</turn>)|<(image|audio|document|other) ([0-9]+)>|([^\\<>]+)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass
class TokenCosts:
    """How many tokens an attachment expands to."""

    patch: int = 28
    audio_per_second: float = 25.0
    per_page: int = 1500


@dataclass
class Flattener:
    """Visits the parts of a conversation in order."""

    costs: TokenCosts = field(default_factory=TokenCosts)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        visitors = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        return visitors.get(part.get("kind") or "text", self.visit_other)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        side = self.costs.patch
        return self._attach("image", part, math.ceil((part.get("width") or 0) / side) * math.ceil((part.get("height") or 0) / side))

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.costs.audio_per_second))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, (part.get("pages") or 0) * self.costs.per_page)

    def visit_other(self, part: dict) -> str:
        return self._attach(part["kind"], part, 0, "other")

    def _attach(self, kind: str, part: dict, tokens: int, shown: str = "") -> str:
        number = len(self.attachments)
        self.attachments.append({"number": number, "kind": kind, "uri": part.get("uri"), "tokens": int(tokens)})
        return f"<{shown or kind} {number}>"


def render(turns: list[tuple[str | None, list[dict] | None]], trained: tuple[str, ...], costs: TokenCosts | None = None) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """The string, the loss mask as spans of it, and the attachments."""
    flat, out, at, mask = Flattener(costs or TokenCosts()), [], 0, []
    for role, parts in turns:
        head = f"<turn {escape(role or '')}>"
        body = "".join(flat.visit(p) for p in parts or [])
        if role in trained:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>"]
        at += len(head) + len(body) + 7
    return "".join(out), mask, flat.attachments


def read_back(formatted: str) -> list[tuple[str, str, list[tuple[str, int]]]]:
    """(role, text, placeholders) of each turn of a formatted conversation."""
    turns, role, text, found = [], None, [], []
    for m in _MARK.finditer(formatted):
        if m[2] is not None:
            role, text, found = unescape(m[2]), [], []
        elif m[3]:
            turns.append((role or "", "".join(text), found))
            role = None
        elif m[4]:
            found.append((m[4], int(m[5])))
        else:
            text.append(m[6] if m[1] is None else m[1])
    return turns


def format_conversations(messages: DataFrame, parts_col: str = "parts", trained: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """(id, formatted, mask, attachments): a row for each conversation.

    ``parts_col`` is an array of typed parts; a null array or part text is empty, a
    null kind is text, and any other kind is a placeholder with its reference. Turns are in the order of the turn
    column, null first; equal ones by role, then by parts, so repeated rows are
    repeated turns. A null role is empty. Rows with a null id form one conversation of
    null id. An empty table gives an empty result. A conversation is read in one piece,
    as it is one row of the result. Other columns are ignored, whatever their names.
    """
    kept = messages.select(F.col(id_col).alias("k"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(parts_col).alias("parts"))
    kept = kept.withColumn("key", F.xxhash64("k", F.col("k").isNull())).withColumn("order", F.to_json("parts"))
    schema = f"k {kept.schema['k'].dataType.simpleString()}, formatted string, mask array<struct<start:bigint,end:bigint>>, attachments array<{ATTACHMENT}>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ["key"]):
            ids, roles, parts = table.column("k").to_pylist(), table.column("role").to_pylist(), table.column("parts").to_pylist()
            out: list[list] = [[], [], [], []]
            own = [i for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(a, b) if i == a or ids[i] != ids[i - 1]]
            for a, b in zip(own, [*own[1:], len(ids)], strict=True):
                text, mask, attached = render(list(zip(roles[a:b], parts[a:b], strict=True)), trained)
                for column, value in zip(out, (ids[a], text, [{"start": s, "end": e} for s, e in mask], attached), strict=True):
                    column.append(value)
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            refs = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], table.schema.field("k").type), pa.array(out[1], pa.string()), pa.array(out[2], spans), pa.array(out[3], refs)], names=["k", "formatted", "mask", "attachments"])

    dealt = kept.repartition("key").sortWithinPartitions("key", "k", "turn", "role", "order").drop("order", "turn")
    return dealt.mapInArrow(work, schema).withColumnRenamed("k", id_col)


def text_parts(text_col: str = "text"):
    """A column of one text part, for tables whose turns are plain text."""
    kinds = {"kind": "string", "text": "string", "uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    values = {"kind": F.lit("text"), "text": F.col(text_col)}
    return F.array(F.struct(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items())))


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What reading back the formatted strings gives, as counts and digests."""
    names = ["k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = f"k {formatted.schema[id_col].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                said = "".join(f"{role}\n{words}\n" for role, words, _ in turns)
                loss = "".join(words for _, words, _ in (t for s in mask for t in read_back(f"<turn >{text[s['start'] : s['end']]}</turn>")))
                row = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=names)

    return formatted.select(id_col, "formatted", "mask").mapInArrow(work, schema).withColumnRenamed("k", id_col)


#: The rows of the op5 query in DuckDB.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>') AS r, replace(replace(replace(text, '\', '\\'), '<', '\<'), '>', '\>') AS t FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(r) + length(t)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
