"""Stored conversations (H1-H9). Rows: ``conversation_id, order_index, role, content,
tool_calls, artifact, status, message_metadata``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.text import strip
from docframe.operators.ordered import number_rows, sql, top_per_key

# History length, title length and the artifact kinds that ground an answer.
KEEP_LAST = 24
TITLE_CHARS = 80
NO_TITLE = "New conversation"
NO_ANSWER = "I could not produce a response."
GROUNDED_KINDS = "('paper_answer', 'comparison', 'research_report')"


def bound_history(messages: DataFrame, keep_last: int = KEEP_LAST) -> DataFrame:
    """Last messages per conversation, renumbered from 0; a limit of 0 keeps all (H1)."""
    if keep_last <= 0:
        every = number_rows(messages, ["conversation_id"], "order_index", "__n")
        return every.selectExpr(*[("__n - 1 AS order_index" if c == "order_index" else f"`{c}`") for c in messages.columns])
    last = top_per_key(messages, ["conversation_id"], keep_last, "order_index DESC", rank="__back")
    place = "max(__back) OVER (PARTITION BY conversation_id) - __back AS order_index"
    return last.selectExpr(*[(place if c == "order_index" else f"`{c}`") for c in messages.columns])


def derive_title(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Existing title, else the first human message cut to 80 characters (H2)."""
    firsts = messages.filter("role = 'human'").groupBy("conversation_id").agg(
        F.expr(f"min_by({strip('content')}, order_index) AS __first")
    )
    return conversations.join(firsts, "conversation_id", "left").selectExpr(
        "conversation_id", f"coalesce(nullif(title, ''), nullif(left(__first, {TITLE_CHARS}), ''), '{NO_TITLE}') AS title"
    )


def chat_turns(messages: DataFrame) -> DataFrame:
    """User and assistant turns for display; tool traffic is dropped (H3)."""
    shown = messages.filter("role = 'human' OR (role = 'ai' AND coalesce(size(tool_calls), 0) <= 0)")
    return shown.selectExpr(
        "conversation_id", "order_index", "IF(role = 'human', 'user', 'assistant') AS role", "content",
        "IF(role = 'human', coalesce(message_metadata.has_image, false), NULL) AS has_image",
        "IF(role = 'human', message_metadata.image_mime, NULL) AS image_mime",
    )


def list_conversations(conversations: DataFrame, user_id: str, limit: int = 100) -> DataFrame:
    """Most recently updated first (H4)."""
    own = conversations.filter(F.col("user_id") == user_id)
    return own.orderBy(F.col("updated_at").desc(), "conversation_id").limit(limit)


def flatten_content(blocks: str) -> str:
    """Concatenated text of the text blocks (H6)."""
    return f"array_join(transform(filter({blocks}, b -> b.type IN ('text', 'output_text')), b -> coalesce(b.text, '')), '')"


def image_metadata(blocks: str) -> str:
    """Image flag and MIME type of a block list, without the payload (H7)."""
    urls = f"filter({blocks}, b -> b.type = 'image_url')"
    url = f"try_element_at({urls}, 1).url"
    return (
        f"named_struct('has_image', exists({blocks}, b -> b.type IN ('image_url', 'image')), "
        f"'image_mime', IF(startswith({url}, 'data:'), lower(regexp_extract({url}, '^data:([^;]*)', 1)), NULL))"
    )


def collect_results(messages: DataFrame) -> DataFrame:
    """Answer, grounding and tool counts per conversation (H8). Rows after the history are
    marked ``is_new``; tool calls, artifacts and citations themselves are the rows of
    ``tool_trace``, ``result_artifacts`` and ``result_citations``."""
    return sql(
        f"""
        SELECT conversation_id, coalesce(max_by(content, IF(role = 'ai' AND content <> ''
            AND coalesce(size(tool_calls), 0) <= 0, order_index, NULL)), '{NO_ANSWER}') AS answer,
          coalesce(bool_or(is_new AND role = 'tool' AND artifact.kind IN {GROUNDED_KINDS}), false) AS grounded,
          coalesce(sum(IF(is_new AND role = 'ai', greatest(coalesce(size(tool_calls), 0), 0), IF(is_new AND role = 'tool', 1, 0))), 0) AS tool_events,
          coalesce(sum(IF(is_new AND role = 'tool', greatest(coalesce(size(artifact.citations), 0), 0), 0)), 0) AS citations
        FROM {{m}} GROUP BY conversation_id
        """,
        m=messages,
    )


def tool_trace(messages: DataFrame) -> DataFrame:
    """Requested calls with their arguments and finished tools after the history, in order (H8)."""
    new = messages.filter("is_new")
    args = next((f.dataType.elementType for f in messages.schema if f.name == "tool_calls"), None)
    given = "to_json(call.args)" if args is not None and "args" in args.names and args["args"].dataType.simpleString() != "string" else (
        "call.args" if args is not None and "args" in args.names else "CAST(NULL AS STRING)")
    asked = new.filter("role = 'ai'").selectExpr("conversation_id", "order_index", "posexplode(tool_calls) AS (pos, call)").selectExpr(
        "conversation_id", "order_index", "pos", "call.name AS name", f"{given} AS arguments", "'requested' AS status")
    done = new.filter("role = 'tool'").selectExpr(
        "conversation_id", "order_index", "0 AS pos", "tool_name AS name", "CAST(NULL AS STRING) AS arguments", "status")
    return asked.unionByName(done)


def result_artifacts(messages: DataFrame) -> DataFrame:
    """Artifacts of the tools after the history, a row each (H8)."""
    return messages.filter("is_new AND role = 'tool' AND artifact IS NOT NULL").select("conversation_id", "order_index", "artifact")


def result_citations(messages: DataFrame) -> DataFrame:
    """Citations of these artifacts in their order, a row each (H8)."""
    return result_artifacts(messages).selectExpr("conversation_id", "order_index", "posexplode(artifact.citations) AS (pos, citation)")


def stream_events(events: DataFrame) -> DataFrame:
    """Events for the client (H9): the start, non-empty tokens of the root node, tool events, the end.
    Stateless, so it works on a stream as well."""
    shown = "(kind = 'token' AND node = 'model' AND content <> '') OR kind IN ('start', 'tool_call', 'tool_result', 'done')"
    return events.filter(shown).selectExpr(
        "*", "CASE kind WHEN 'token' THEN 'token' WHEN 'start' THEN 'start' WHEN 'done' THEN 'done' ELSE 'tool' END AS event",
        "CASE kind WHEN 'tool_call' THEN 'running' WHEN 'tool_result' THEN status END AS event_status",
    )
