"""Builders of memory texts: nested conversation data becomes agents, requests and traces.

Every builder is a DataFrame transform over rows with an order column; results have
a row for each request: (agent, agent_role, request_index, ..., trace array<struct<text, ...>>).
flatten() gives a row for each text.  agents() nests requests under their agent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Names, roles and prompts of the texts.
CHAT_AGENT = "HuggingFaceH4/ultrachat_200k"
CHAT_ROLE = "You are a helpful chat robot, you need to follow the instructions and solve the problems."
STEPS_AGENT = "sl-alex/openai-prm800k-stepwise-best"
STEPS_ROLE = "You are a mathematician who excels at advanced mathematical reasoning tasks."
TAGGED_AGENT = "thesven/gsm8k-reasoning"
TAGGED_ROLE = "You are an AI assistant that uses a Chain of Thought (CoT) approach with reflection to answer queries."
FEEDBACK_AGENT = "openbmb/UltraFeedback"
SOLVE_ROLE = "You are a useful agent to solve user questions."
CRITIQUE_ROLE = "You are a agent to criticize the response to a given question."
EVAL_KEYS = ("helpfulness", "honesty", "instruction_following", "truthfulness")
CALLS_AGENT = "Salesforce/xlam-function-calling-60k"
CALLS_ROLE = "You are a helpful agent that can use API calls to solve problems. You need to select the best tool, read the specification and generate the target function call."
TOOLS_TEXT = "agent role: You are a useful agent to use different tools. Following is the specification to an agent tool you need to use: "
CALL_TEXT = "agent role: You are a useful agent to generate tool calls. Agent tool call. answer: "


def eval_role(metric: str) -> str:
    return f"You are a agent to evaluate the {metric} of a given response."


def _request_index(rows: DataFrame, order: str, limit: int | None) -> DataFrame:
    """Numbers kept requests from 0 in source order, all of one agent; and stops at the limit."""
    from .stats import numbered

    rows = rows if limit is None else rows.orderBy(order).limit(limit)
    return numbered(rows, order).withColumnRenamed("row", "request_index")


def _pairs(turns: Column, ask: str, answer: str) -> Column:
    """(user, assistant) of each answering turn right after an asking one, blank turns and other roles aside."""
    kept = F.filter(turns, lambda t: t["role"].isin(ask, answer) & (t["text"] != ""))
    before = F.concat(F.array(F.struct(F.lit("").alias("role"), F.lit("").alias("text"))), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
    both = F.zip_with(kept, before, lambda t, b: F.struct(b["role"].alias("was"), t["role"].alias("role"), b["text"].alias("asked"), t["text"].alias("answered")))
    both = F.filter(both, lambda p: (p["was"] == ask) & (p["role"] == answer))
    return F.transform(both, lambda p: F.struct(p["asked"].alias("asked"), p["answered"].alias("answered")))


def _turns(conversation: Column, role: str, text: str, trim_role: bool) -> Column:
    def one(t: Column) -> Column:
        who = F.lower(F.coalesce(t[role], F.lit("")))
        return F.struct((X.strip(who) if trim_role else who).alias("role"), F.coalesce(X.strip(t[text]), F.lit("")).alias("text"))

    return F.transform(conversation, one)


def pair_turns(rows: DataFrame, conv: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(conv, order, asked, answered) of flat turns: an assistant's turn right after a user's, blank turns and other roles aside."""
    said = rows.select(conv, order, X.strip(F.lower(F.col(role))).alias("__role"), X.strip(F.col(text)).alias("__text")).where(F.col("__role").isin("user", "assistant") & (F.col("__text") != ""))
    by = Window.partitionBy(conv).orderBy(order)
    both = said.withColumns({"asked": F.lag("__text").over(by), "__was": F.lag("__role").over(by)})
    return both.where("__role = 'assistant' and __was = 'user'").select(conv, order, "asked", F.col("__text").alias("answered"))


def first_filled_list(*columns: Column) -> Column:
    """The first of several arrays that has an element."""
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in columns))


def trajectories(rows: DataFrame, order: str, conversation: Column, limit: int | None = None, words: int = 20) -> DataFrame:
    """Agent trajectories: conversation array<struct<from, value>>.

    An agent is the first words of the first human turn; requests are numbered within
    it, and the limit holds for each agent.
    """
    turns = _turns(conversation, "from", "value", trim_role=False)
    opening = F.try_element_at(F.filter("turns", lambda t: (t["role"] == "human") & (t["text"] != "")), F.lit(1))["text"]
    rows = rows.select(F.col(order).alias("__order"), turns.alias("turns")).withColumn("opening", opening)
    role = X.first_sentences(F.col("opening"))
    trace = F.transform(
        _pairs(F.col("turns"), "human", "gpt"),
        lambda p: F.struct(p["asked"].alias("human"), p["answered"].alias("gpt"), F.concat(F.lit("agent role: "), role, F.lit("\nhuman question: "), p["asked"], F.lit("\ngpt answer: "), p["answered"]).alias("text")),
    )
    rows = rows.select("__order", X.first_words(F.col("opening"), words).alias("agent"), trace.alias("trace")).where((F.size("trace") > 0) & (F.coalesce("agent", F.lit("")) != ""))
    out = rows.withColumn("request_index", F.row_number().over(Window.partitionBy("agent").orderBy("__order")) - 1)
    out = out if limit is None else out.where(F.col("request_index") < limit)
    return out.select("agent", F.lit(None).cast("string").alias("agent_role"), "request_index", "trace")


def chats(rows: DataFrame, order: str, prompt: Column, messages: Column, limit: int | None = None) -> DataFrame:
    """Multi-turn chats: messages array<struct<role, content>>; all are requests of one agent."""
    asked = F.coalesce(X.strip(prompt), F.lit(""))
    rows = rows.select(F.col(order).alias("__order"), asked.alias("prompt"), messages.alias("__messages"))
    trace = F.transform(
        _pairs(_turns(F.col("__messages"), "role", "content", trim_role=True), "user", "assistant"),
        lambda p: F.struct(p["asked"].alias("user"), p["answered"].alias("assistant"), F.concat(F.lit(f"agent role: {CHAT_ROLE}\n initial question: "), F.col("prompt"), F.lit("\n user question: "), p["asked"], F.lit("\n answer: "), p["answered"]).alias("text")),
    )
    rows = rows.select("__order", "prompt", trace.alias("trace")).where(F.size("trace") > 0)
    return _request_index(rows, "__order", limit).select(F.lit(CHAT_AGENT).alias("agent"), F.lit(CHAT_ROLE).alias("agent_role"), "request_index", "prompt", "trace")


def math_steps(rows: DataFrame, order: str, instruction: Column, response: Column, answer: Column, limit: int | None = None) -> DataFrame:
    """Steps of reasoning, grouped by instruction in the order of first sight; the limit counts instructions."""
    rows = rows.select(F.col(order).alias("__order"), X.filled(instruction).alias("instruction"), X.filled(response).alias("response"), X.filled(answer.cast("string")).alias("answer")).where("instruction is not null and response is not null")
    said = F.when(F.col("answer").isNotNull() & (F.lower("answer") != "none"), F.concat(F.lit("\nanswer: "), F.col("answer"))).otherwise(F.lit(""))
    text = F.concat(F.lit(f"agent role: {STEPS_ROLE}\nquestion: "), F.col("instruction"), F.lit("\nresponse: "), F.col("response"), said)
    grouped = rows.groupBy("instruction").agg(F.min("__order").alias("__order"), F.array_sort(F.collect_list(F.struct("__order", text.alias("text")))).alias("steps"))
    grouped = grouped.withColumn("trace", F.transform("steps", lambda s: F.struct(s["text"].alias("text"))))
    return _request_index(grouped, "__order", limit).select(F.lit(STEPS_AGENT).alias("agent"), F.lit(None).cast("string").alias("agent_role"), "request_index", "instruction", "trace")


def tagged_reasoning(rows: DataFrame, order: str, question: Column, answer: Column, generation: Column, limit: int | None = None) -> DataFrame:
    """Generations with tagged sections: a text for each section that isn't blank; output sections carry the true answer."""
    rows = rows.select(F.col(order).alias("__order"), X.filled(question.cast("string")).alias("question"), X.filled(answer.cast("string")).alias("answer"), X.filled(generation.cast("string")).alias("generation")).where("question is not null and generation is not null")
    truth = lambda s: F.when((F.lower(s["tag"]) == "output") & F.col("answer").isNotNull(), F.concat(F.lit("\nground truth answer: "), F.col("answer"))).otherwise(F.lit(""))
    text = lambda s: F.concat(F.lit(f"agent role: {TAGGED_ROLE}\nquestion: "), F.col("question"), F.lit("\nanswer: ["), s["tag"], F.lit("] "), s["body"], truth(s))
    sections = F.filter(X.tagged_sections(F.col("generation")), lambda s: s["body"] != "")
    rows = rows.withColumn("trace", F.transform(sections, lambda s: F.struct(s["tag"].alias("tag"), text(s).alias("text")))).where(F.size("trace") > 0)
    return _request_index(rows, "__order", limit).select(F.lit(TAGGED_AGENT).alias("agent"), F.lit(TAGGED_ROLE).alias("agent_role"), "request_index", "question", "answer", "trace")


def feedback(rows: DataFrame, order: str, instruction: Column, models: Column, completions: Column, limit: int | None = None) -> DataFrame:
    """Preference feedback: six texts for each model's completion; models and completions pair up to the shorter list.

    completions array<struct<response, critique, overall_score, annotations map<string,string>>>.
    """
    rows = rows.select(F.col(order).alias("__order"), X.filled(instruction).alias("instruction"), models.alias("models"), completions.alias("completions"))
    n = F.least(F.size("models"), F.size("completions"))
    both = F.zip_with(F.slice("models", 1, F.greatest(n, F.lit(0))), F.slice("completions", 1, F.greatest(n, F.lit(0))), lambda m, c: F.struct(X.strip(m).alias("model"), c.alias("c")))
    both = F.filter(both, lambda p: (F.coalesce(p["model"], F.lit("")) != "") & (F.coalesce(X.strip(p["c"]["response"]), F.lit("")) != ""))
    said = lambda c: F.coalesce(X.strip(c.cast("string")), F.lit(""))

    def texts(p: Column) -> Column:
        c = p["c"]
        solved = F.concat(F.lit(f"agent role: {SOLVE_ROLE} question: "), F.col("instruction"), F.lit(" model: "), p["model"], F.lit(" answer: "), said(c["response"]))
        judged = F.concat(F.lit(f"agent role: {CRITIQUE_ROLE} critique: "), said(c["critique"]), F.lit(", overall_score: "), said(c["overall_score"]))
        rated = [F.concat(F.lit(f"agent role: {eval_role(k)} evaluation: "), said(F.try_element_at(c["annotations"], F.lit(k)))) for k in EVAL_KEYS]
        return F.array(*(F.struct(t.alias("text")) for t in (solved, judged, *rated)))

    rows = rows.where("instruction is not null").withColumn("trace", F.flatten(F.transform(both, texts))).where(F.size("trace") > 0)
    return _request_index(rows, "__order", limit).select(F.lit(FEEDBACK_AGENT).alias("agent"), F.lit(None).cast("string").alias("agent_role"), "request_index", "instruction", "trace")


def function_calls(rows: DataFrame, order: str, query: Column, tools: Column, answers: Column, limit: int | None = None) -> DataFrame:
    """Function calls: three texts for each query with tools and answers, as text."""
    rows = rows.select(F.col(order).alias("__order"), X.filled(query).alias("query"), X.filled(tools).alias("tools"), X.filled(answers).alias("answers")).where("query is not null and tools is not null and answers is not null")
    texts = (F.concat(F.lit(f"agent role: {CALLS_ROLE} question: "), F.col("query")), F.concat(F.lit(TOOLS_TEXT), F.col("tools")), F.concat(F.lit(CALL_TEXT), F.col("answers")))
    rows = rows.withColumn("trace", F.array(*(F.struct(t.alias("text")) for t in texts)))
    return _request_index(rows, "__order", limit).select(F.lit(CALLS_AGENT).alias("agent"), F.lit(CALLS_ROLE).alias("agent_role"), "request_index", "query", "tools", "answers", "trace")


def flatten(requests: DataFrame, limit: int | None = None) -> DataFrame:
    """(agent, request_index, trace_index, text), a row for each text; the first `limit` in that order."""
    out = requests.select("agent", "request_index", F.posexplode("trace").alias("trace_index", "t")).select("agent", "request_index", "trace_index", F.col("t.text").alias("text"))
    return out if limit is None else out.orderBy("agent", "request_index", "trace_index").limit(limit)


def agents(requests: DataFrame) -> DataFrame:
    """(agent, agent_role, requests array): requests nested under their agent, in order."""
    return requests.groupBy("agent", "agent_role").agg(F.array_sort(F.collect_list(F.struct("request_index", "trace"))).alias("requests"))


ROLE_FIELDS = ("user", "assistant", "human", "gpt")


def entry_text(text: Column, fields: list[Column], joined: bool) -> Column:
    """A trace entry's text; else all its role fields joined by blanks, or the first of them."""
    filled = [X.filled(f) for f in fields]
    return F.coalesce(X.filled(text), F.nullif(F.concat_ws(" ", *filled), F.lit("")) if joined else F.coalesce(*filled))


def first_per_id(rows: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """(id, text, metadata) of passages (text_id, id, title, text): no blank text; the first of an id stays; metadata holds the title."""
    from .mutate import first
    from .stats import numbered

    rows = numbered(rows, order)
    key = F.coalesce(X.filled(F.col("text_id").cast("string")), X.filled(F.col("id").cast("string")), F.col("row").cast("string"))
    kept = rows.withColumns({"__id": key, "__text": X.filled(F.col("text"))}).where("__text is not null")
    kept = first(kept, "__id", "row")
    kept = kept if limit is None else kept.orderBy("row").limit(limit)
    title = F.when(X.filled(F.col("title")).isNotNull(), F.create_map(F.lit("title"), X.strip(F.col("title"))))
    return kept.select("row", F.col("__id").alias("id"), F.col("__text").alias("text"), title.alias("metadata"))


def questions(rows: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """(question, answer) of rows with a question and a first golden answer."""
    out = rows.select(order, X.filled(F.col("question")).alias("question"), X.filled(F.try_element_at("golden_answers", F.lit(1))).alias("answer")).where("question is not null and answer is not null")
    return (out if limit is None else out.orderBy(order).limit(limit)).drop(order)
