"""Conversations through a chat template, and the formatted text read back.

Turns are sorted by (turn, role, text) within a conversation and rendered one by
one as they stream through a task, so a conversation of any length needs the
memory of one batch; as its digests run over all turns in order, it is one task's work. A segment is what one turn adds to the conversation's text;
segments in order are the whole text. Loss spans count code points within the
segment.

Defined results: null texts and roles are empty; a null turn comes first; repeated
rows are turns of their own; rows without a conv_id are one conversation whose id
is null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmerge.llm.chat_template import Template, TemplateError, unescape
from shelfmerge.llm.common import in_text_batches

TEMPLATE = """{% for m in messages %}<s>[ROLE]{{ m.role | escape }}[/ROLE]
{%- if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>{% endfor %}"""

#: A turn of TEMPLATE; texts hold none of its marks unescaped.
TURN = re.compile(r"<s>\[ROLE\](?P<role>.*?)\[/ROLE\](?:\[INST\](?P<other>.*?)\[/INST\]|(?P<own>.*?))</s>", re.S)

SEGMENTS = "conv_id bigint, seq bigint, text string, loss_spans array<struct<start:bigint,end:bigint>>"


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, seq, text, loss_spans): the segments of every conversation, in order within a partition."""
    if not Template(template).streams:  # a bad template fails here, not inside a task
        raise TemplateError("this template reads the messages as a whole")
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_text_batches(dealt, renderer(template), SEGMENTS)


def renderer(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        held, k, rows = None, 0, []

        def put(last: bool) -> None:
            out = compiled.render_one({"role": held[1], "text": held[2]}, k, last)
            spans = [{"start": a, "end": b} for a, b in out.spans]
            rows.append({"conv_id": held[0], "seq": k, "text": "".join(out.parts), "loss_spans": spans})

        for batch in batches:
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for row in zip(ids, roles, texts, strict=True):
                if held is not None:
                    put(row[0] != held[0])
                    k = k + 1 if row[0] == held[0] else 0
                held = row
            if rows:
                yield segment_batch(rows)
                rows = []
        if held is not None:
            put(True)
            yield segment_batch(rows)

    return run


def segment_batch(rows: list[dict]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("loss_spans", spans)])
    return pa.RecordBatch.from_pylist(rows, schema)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in text that TEMPLATE has formatted; anything else is an error."""
    at = 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise TemplateError(f"no turn at {at}: {text[at : at + 30]!r}")
        yield unescape(m["role"]), unescape(m["other"] if m["other"] is not None else m["own"])
        at = m.end()


READ = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)

READ_SCHEMA = pa.schema(
    [(f.split()[0], pa.int64() if "bigint" in f else pa.string()) for f in READ.split(", ")]
)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations whose segments come in order."""
    rows: list[dict] = []
    now = None

    def finish() -> None:
        rows.append(
            {
                "conv_id": now["id"],
                "n_turns": now["turns"],
                "turns_sha256": now["all"].hexdigest(),
                "loss_chars": now["chars"],
                "loss_sha256": now["loss"].hexdigest(),
                "formatted_chars": now["size"],
            }
        )

    for batch in batches:
        for conv, seq, text, spans in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if seq == 0:
                if now:
                    finish()
                now = {"id": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
            now["size"] += len(text)
            for role, said in read_turns(text):
                now["turns"] += 1
                now["all"].update(f"{role}\n{said}\n".encode())
            for s in spans:
                own = unescape(text[s["start"] : s["end"]])
                now["chars"] += len(own)
                now["loss"].update(own.encode())
        if len(rows) > 1000:
            yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)
            rows = []
    if now:
        finish()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: control strings as texts."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string"
    )


def chat_report(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """All turns and the control conversation formatted, then read back from the segments."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    return format_conversations(rows.union(control_conversation(spark))).mapInArrow(read_back, READ)
