"""Tool-call envelopes of agents: what the tool printed, and the answer that replaces it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which member holds the tool's output, by protocol.
OUTPUT_MEMBER = {"claude": "tool_output", "opencode": "tool_output", "kilo": "tool_output", "pi": "tool_output", "codex": "tool_response", "devin": "tool_response", "droid": "tool_response"}
DROID_MEMBERS = ("output", "content", "stdout", "result", "text")


def _text_member(json: Column, path: str) -> Column:
    """The member if it is a text; null if it is anything else."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(json), path, "variant"))
    return F.when(kind == "STRING", F.get_json_object(json, path))


def tool_output(envelope: Column, protocol: str) -> Column:
    """The tool's output: texts as they are, other values as JSON."""
    member = F.get_json_object(envelope, f"$.{OUTPUT_MEMBER[protocol]}")
    is_object = F.ltrim(member).startswith("{")
    if protocol == "devin":
        return F.when(is_object, F.get_json_object(member, "$.output")).otherwise(member)
    if protocol == "droid":
        texts = F.array_join(F.filter(F.from_json(F.get_json_object(member, "$.content[*].text"), "array<string>"), lambda x: x.isNotNull()), "\n")
        return F.when(is_object, F.coalesce(*[_text_member(member, f"$.{m}") for m in DROID_MEMBERS], F.when(texts != "", texts), member)).otherwise(member)
    return member


def answer(text: Column, protocol: str) -> Column:
    """The envelope that replaces the output by a converted text; null where the agent would only append it."""
    event = F.lit("PostToolUse")
    if protocol in ("claude", "opencode", "kilo", "pi"):
        return F.when(text.isNotNull(), F.to_json(F.struct(F.struct(event.alias("hookEventName"), text.alias("updatedToolOutput")).alias("hookSpecificOutput"))))
    if protocol == "codex":
        return F.when(text.isNotNull(), F.to_json(F.struct(F.lit(False).alias("continue"), F.lit("block").alias("decision"), text.alias("reason"), F.struct(event.alias("hookEventName")).alias("hookSpecificOutput"))))
    return F.lit(None).cast("string")
