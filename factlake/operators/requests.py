"""Requests to a language model as rows.

The call itself is outside: these tables are handed to whatever makes it, and
its replies come back as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .grouping import fresh_keys, range_ordinal

# fixed values
ENTITY_TYPES = ["Client", "Project", "Decision", "Person", "Process", "Belief"]
RELATIONSHIP_TYPES = ["owns", "works_on", "belongs_to", "made_by", "assigned_to", "reports_to", "part_of", "manages"]
BATCH_SIZE = 10
HISTORY = "slack_history"
DEFAULT_FOCUS = ("Cover: what the team should focus on today, any open decisions or beliefs worth remembering, "
                 "and one key reminder.")

# Wording of the requests; callers may pass their own with the same marks.
TEMPLATES = {
    "extraction": (
        "List the business facts in the message and how they relate. Answer with one JSON object: "
        "\"entities\" holds objects with entity_type (" + ", ".join(ENTITY_TYPES) + "), name and content; "
        "\"relationships\" holds objects with from_name, from_type, relationship_type ("
        + ", ".join(RELATIONSHIP_TYPES) + "), to_name and to_type. Leave both empty if nothing is stated.\n\n{message}"
    ),
    "batch": (
        "List the business facts of each numbered message. Answer with a JSON array of objects with "
        "message_index, entities and relationships.\n\n{messages}"
    ),
    "critic": (
        "Is this fact supported by the message? Answer with JSON: approved, confidence_score (0 to 1), reason.\n\n"
        "Message: {message}\nType: {entity_type}\nName: {name}\nFact: {content}"
    ),
    "judge": "Question: {question}\nExpected: {expected}\nActual: {actual}\nDo they agree? Answer PASS or FAIL.",
    "briefing": "Write a morning briefing of at most 150 words.\n{focus}\n\n{context}",
    "belief": (
        "Does the action go against one of the beliefs? Answer with JSON: conflict, belief, reason.\n\n"
        "Action: {action}\n\nBeliefs:\n{beliefs}"
    ),
    "contradiction": (
        "Does the new fact contradict the memory? Answer with JSON: contradiction, reason.\n\n"
        "New: {content}\n\nMemory:\n{context}"
    ),
    "draft": (
        "Write what the task asks for, from the memory alone.\n\nTask: {task}\n\nMemory:\n{context}"
    ),
    "answer": (
        "Answer from the memory below and name the facts you use.\n\n== Business Profile ==\n{profile}\n{memory}\n\n{question}"
    ),
}


def fill(template: str, **values: Column) -> Column:
    """Template text with each ``{mark}`` replaced; values may hold marks themselves."""
    parts, rest = [], template
    while rest:
        marks = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not marks:
            break
        at, key = min(marks)
        parts += [F.lit(rest[:at]), F.coalesce(values[key].cast("string"), F.lit(""))]
        rest = rest[at + len(key) + 2:]
    return F.concat(*parts, F.lit(rest))


def _request(rows: DataFrame, request_id: Column, kind: str, tier: Column, text: Column, *keep: str) -> DataFrame:
    return rows.select(
        request_id.cast("string").alias("request_id"), F.lit(kind).alias("kind"), *keep,
        tier.alias("model_tier"), text.alias("text"),
    )


def extraction_requests(sources: DataFrame, template: str = TEMPLATES["extraction"]) -> DataFrame:
    content = F.col("raw_content")
    return _request(sources, F.col("id"), "extraction", X.model_tier(content), fill(template, message=content), "org_id")


def critic_requests(candidates: DataFrame, sources: DataFrame, template: str = TEMPLATES["critic"]) -> DataFrame:
    """One request per candidate; ``candidates`` has ``seq, source_id, entity_type, name, content``."""
    texts = sources.select(F.col("id").alias("src_id"), "raw_content")
    rows = candidates.join(texts, candidates["source_id"] == texts["src_id"])
    text = fill(template, message=F.col("raw_content"), entity_type=F.col("entity_type"), name=F.col("name"), content=F.col("content"))
    return _request(rows, F.col("seq"), "critic", F.lit("full"), text, "org_id")


def judge_requests(evals: DataFrame, template: str = TEMPLATES["judge"]) -> DataFrame:
    text = fill(template, question=F.col("question"), expected=F.col("expected_answer"), actual=F.col("actual"))
    return _request(evals, F.col("id"), "judge", F.lit("full"), text, "org_id")


def briefing_requests(contexts: DataFrame, profiles: DataFrame, template: str = TEMPLATES["briefing"]) -> DataFrame:
    """One request per organisation."""
    focus = profiles.select("org_id", X.or_else(F.col("briefing_focus"), DEFAULT_FOCUS).alias("focus"))
    rows = contexts.join(focus, "org_id", "left")
    text = fill(template, focus=F.coalesce("focus", F.lit(DEFAULT_FOCUS)), context=F.col("context"))
    return _request(rows, F.concat_ws("/", "org_id", F.col("part").cast("string")), "briefing", F.lit("fast"), text, "org_id")


def belief_requests(tasks: DataFrame, belief_blocks: DataFrame, template: str = TEMPLATES["belief"]) -> DataFrame:
    """One request per task with its organisation's beliefs; none where it has no belief."""
    rows = tasks.join(belief_blocks, "org_id")
    text = fill(template, action=F.col("question"), beliefs=F.col("beliefs"))
    return _request(rows, F.concat_ws("/", F.col("query_id").cast("string"), F.col("part").cast("string")),
                    "belief", F.lit("full"), text, "org_id")


def contradiction_requests(blocks: DataFrame, template: str = TEMPLATES["contradiction"]) -> DataFrame:
    """One request per new fact with neighbours; ``blocks`` has ``query_id, org_id, content, fact_block``."""
    text = fill(template, content=F.col("content"), context=F.col("fact_block"))
    return _request(blocks, F.col("query_id"), "contradiction", F.lit("full"), text, "org_id")


def answer_requests(contexts: DataFrame, template: str = TEMPLATES["answer"]) -> DataFrame:
    """One request per question; ``contexts`` has ``query_id, org_id, question, profile, memory``."""
    text = fill(template, profile=F.col("profile"), memory=F.col("memory"), question=F.col("question"))
    return _request(contexts, F.col("query_id"), "answer", F.lit("full"), text, "org_id")


def draft_requests(tasks: DataFrame, blocks: DataFrame, template: str = TEMPLATES["draft"]) -> DataFrame:
    """One request per drafting task that memory was found for; ``blocks`` has ``query_id, fact_block``."""
    rows = tasks.filter(F.col("task_type") == "draft").join(blocks.select("query_id", "fact_block"), "query_id")
    text = fill(template, task=F.col("question"), context=F.col("fact_block"))
    return _request(rows, F.col("query_id"), "draft", F.lit("full"), text, "org_id")


def within_budget(requests: DataFrame, budgets: DataFrame) -> DataFrame:
    """Requests of organisations that have not used up their month; ``budgets`` has ``org_id, over_budget``."""
    return requests.join(fresh_keys(budgets.filter("over_budget").select("org_id"), "org_id"), "org_id", "left_anti").select(
        *requests.columns)


def over_budget(requests: DataFrame, budgets: DataFrame) -> DataFrame:
    """The requests that ``within_budget`` leaves out."""
    return requests.join(fresh_keys(budgets.filter("over_budget").select("org_id").distinct(), "org_id"), "org_id", "left_semi").select(
        *requests.columns)


def backlog(sources: DataFrame) -> DataFrame:
    return sources.filter((F.col("source_type") == HISTORY) & F.col("processed_at").isNull())


def pack_batches(sources: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Places each source in a batch of its organisation, in id order; ids may be any numbers."""
    numbered = range_ordinal(sources, ["org_id"], ["id"])
    place = F.col("ordinal") - 1
    return numbered.withColumns({
        "batch_no": F.floor(place / size), "idx": F.pmod(place, F.lit(size)).cast("int")
    }).drop("ordinal")


def batch_requests(packed: DataFrame, template: str = TEMPLATES["batch"]) -> DataFrame:
    """One request per batch; a batch holds at most ``BATCH_SIZE`` sources."""
    blocks = packed.groupBy("org_id", "batch_no").agg(
        F.count("*").alias("n"),
        F.expr("listagg('[' || idx || '] ' || raw_content, '\\n\\n') WITHIN GROUP (ORDER BY idx)").alias("messages"),
    )
    return blocks.select(
        F.concat_ws("/", "org_id", F.col("batch_no").cast("string")).alias("request_id"), F.lit("batch").alias("kind"),
        "org_id", "batch_no", "n", F.lit("full").alias("model_tier"), fill(template, messages=F.col("messages")).alias("text"),
    )
