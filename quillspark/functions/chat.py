"""Conversations, ARRAY<STRUCT<role, content>>, as Column expressions; order is the array's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

DEFAULT_SYSTEM = "You are a helpful assistant."
_EMPTY = "array<struct<role:string,content:string>>"


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def empty() -> Column:
    return F.array().cast(_EMPTY)


def normal_roles(c: Column) -> Column:
    """Roles in lower case, human as user and gpt as assistant; null stays null."""
    def role(m: Column) -> Column:
        r = F.lower(F.trim(m["role"]))
        return F.when(r == "human", "user").when(r == "gpt", "assistant").otherwise(r)

    return F.transform(c, lambda m: message(role(m), m["content"]))


def last_index(c: Column, role: str) -> Column:
    """1-based place of the last turn of a role, 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(c, lambda m, i: F.when(m["role"] == role, i + 1).otherwise(0))), F.lit(0))


def to_prompt(c: Column, system: str = DEFAULT_SYSTEM) -> Column:
    """The conversation up to its last user turn, null without one; blank system turns dropped, a default system
    first unless the first turn is a non-blank system."""
    k = last_index(c, "user")
    cut = F.slice(c, F.lit(1), k)
    kept = F.filter(cut, lambda m: ~((m["role"] == "system") & T.is_blank(m["content"])))
    first = F.get(cut, F.lit(0))
    own = (first["role"] == "system") & ~T.is_blank(first["content"])
    return F.when(k > 0, F.when(F.coalesce(own, F.lit(False)), kept).otherwise(F.concat(F.array(message("system", F.lit(system))), kept)))


def seed_messages(c: Column) -> Column:
    """System and user turns that aren't blank; assistants and unknown roles dropped; null without a user turn."""
    kept = F.filter(normal_roles(c), lambda m: m["role"].isin("system", "user") & ~T.is_blank(m["content"]))
    return F.when(F.exists(kept, lambda m: m["role"] == "user"), kept)


def training_messages(c: Column, strip_think: bool = True) -> Column:
    """Turns of the three known roles, reasoning blocks stripped from assistants; null if an assistant becomes empty
    or the last turn isn't an assistant's."""
    def clean(m: Column) -> Column:
        body = F.coalesce(m["content"], F.lit(""))
        return message(m["role"], F.when(m["role"] == "assistant", T.strip_think_blocks(body)).otherwise(body) if strip_think else body)

    kept = F.transform(F.filter(normal_roles(c), lambda m: m["role"].isin("system", "user", "assistant")), clean)
    bad = F.exists(kept, lambda m: (m["role"] == "assistant") & T.is_blank(m["content"]))
    return F.when((F.size(kept) > 0) & ~bad & (F.get(kept, F.size(kept) - 1)["role"] == "assistant"), kept)


def reject_reason(c: Column) -> Column:
    """Why a conversation can't be trained on as it is: empty, bad_role, null_content, not_assistant_last; null if it can."""
    n = F.coalesce(F.size(c), F.lit(0))
    return (
        F.when(n <= 0, "empty")
        .when(F.exists(c, lambda m: ~F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False))), "bad_role")
        .when(F.exists(c, lambda m: m["content"].isNull()), "null_content")
        .when(F.get(c, n - 1)["role"] != "assistant", "not_assistant_last")
    )


def last_turns(c: Column) -> Column:
    """Struct of the last system (default if blank), user and assistant contents; null without user or assistant."""
    get = lambda r: F.get(c, last_index(c, r) - 1)["content"]
    at = lambda r: F.when(last_index(c, r) > 0, get(r))
    sys_ = F.when(T.is_blank(at("system")), F.lit(DEFAULT_SYSTEM)).otherwise(at("system"))
    ok = ~T.is_blank(at("user")) & ~T.is_blank(at("assistant"))
    return F.when(ok, F.struct(sys_.alias("system"), at("user").alias("user"), at("assistant").alias("assistant")))


def user_text(c: Column) -> Column:
    """All user contents joined by a space, nulls skipped."""
    return F.array_join(F.transform(F.filter(c, lambda m: m["role"] == "user"), lambda m: m["content"]), " ")


def assistant_content(content: Column, reasoning: Column, thinking: str = "auto") -> Column:
    """What is stored of an answer and its reasoning for thinking on, off or auto."""
    content, has = F.coalesce(content, F.lit("")), ~T.is_blank(reasoning)
    if thinking == "off":
        return F.when(content != "", content).otherwise(F.coalesce(reasoning, F.lit("")))
    joined = T.strip(F.concat(F.lit("<think>\n"), T.strip(reasoning), F.lit("\n</think>\n\n"), content))
    plain = F.when(~content.contains("<think>"), F.concat(F.lit("<think>\n"), content)).otherwise(content) if thinking == "on" else content
    return F.when(has, joined).otherwise(plain)


def valid_prefix(c: Column) -> Column:
    """The turns up to the first that breaks the order: a user first, tools after assistants or tools, assistants after
    users or tools. A system turn at the start is taken out before and put back."""
    own = F.coalesce(F.get(c, F.lit(0))["role"] == "system", F.lit(False))
    rest = F.when(own, F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)

    def ok(m: Column, i: Column) -> Column:
        before = F.get(rest, i - 1)["role"]
        later = ~((m["role"] == "tool") & ~before.isin("assistant", "tool")) & ~((m["role"] == "assistant") & ~before.isin("user", "tool"))
        return F.when(i == 0, m["role"] == "user").otherwise(F.coalesce(later, F.lit(False)))

    broken = F.array_min(F.transform(rest, lambda m, i: F.when(F.coalesce(ok(m, i), F.lit(False)), F.size(rest)).otherwise(i)))
    kept = F.slice(rest, F.lit(1), F.coalesce(broken, F.lit(0)))
    return F.when(own, F.concat(F.slice(c, 1, 1), kept)).otherwise(kept)


def render_plain(c: Column, user: str, assistant: str, end: str, bos: str = "") -> Column:
    """Plain rendering: system text, user header and text, assistant header, text and end of turn."""
    def one(m: Column) -> Column:
        body = F.coalesce(m["content"], F.lit(""))
        return F.when(m["role"] == "system", body).when(m["role"] == "user", F.concat(F.lit(user), body)).when(m["role"] == "assistant", F.concat(F.lit(assistant), body, F.lit(end))).otherwise("")

    return F.concat(F.lit(bos), F.array_join(F.transform(c, one), ""))


#: What the template says of tools.
_TOOLS_HEAD = "# Tools\n\nYou have access to the following functions:\n\n<tools>"
_TOOLS_TAIL = (
    "\n</tools>\n\nIf you choose to call a function ONLY reply in the following format with NO suffix:\n\n<tool_call>\n<function=example_function_name>\n<parameter=example_parameter_1>\nvalue_1\n</parameter>\n"
    "<parameter=example_parameter_2>\nThis is the value for the second parameter\nthat can span\nmultiple lines\n</parameter>\n</function>\n</tool_call>\n\n<IMPORTANT>\nReminder:\n"
    "- Function calls MUST follow the specified format: an inner <function=...></function> block must be nested within <tool_call></tool_call> XML tags\n- Required parameters MUST be specified\n"
    "- You may provide optional reasoning for your function call in natural language BEFORE the function call, but NOT after\n"
    "- If there is no function call available, answer the question like normal with your current knowledge and do not tell the user about function calls\n</IMPORTANT>"
)


def sanitize_tool_calls(calls: Column) -> Column:
    """Tool calls, JSON text of a list, as ARRAY<STRUCT<id, type, name, arguments MAP>>: other fields go, arguments given as text
    are parsed and empty where they can't be; null where the list itself can't be parsed."""
    raw = F.from_json(calls, "array<struct<id:string,type:string,function:string>>")

    def one(t: Column) -> Column:
        f = t["function"]
        args = F.coalesce(F.from_json(F.get_json_object(f, "$.arguments"), "map<string,string>"), F.create_map().cast("map<string,string>"))
        return F.struct(
            F.coalesce(t["id"], F.lit("")).alias("id"), F.coalesce(t["type"], F.lit("function")).alias("type"), F.coalesce(F.get_json_object(f, "$.name"), F.lit("")).alias("name"), args.alias("arguments")
        )

    return F.transform(F.filter(raw, lambda t: t.isNotNull()), one)


def sanitize_message(m: Column, thinking: bool = False) -> Column:
    """A message with the standard fields only: role, content and sanitised tool_calls, for thinking models reasoning_content too."""
    extra = [m["reasoning_content"].alias("reasoning_content")] if thinking else []
    return F.struct(m["role"].alias("role"), m["content"].alias("content"), sanitize_tool_calls(m["tool_calls"]).alias("tool_calls"), *extra)


def tool_calls_text(calls: Column) -> Column:
    """Sanitised tool calls as the template writes them, one behind the other; empty for none."""
    def one(t: Column) -> Column:
        args = F.transform(F.map_entries(t["arguments"]), lambda e: F.concat(F.lit("<parameter="), e["key"], F.lit(">\n"), F.coalesce(e["value"], F.lit("None")), F.lit("\n</parameter>\n")))
        return F.concat(F.lit("<tool_call>\n<function="), t["name"], F.lit(">\n"), F.array_join(args, ""), F.lit("</function>\n</tool_call>"))

    return F.coalesce(F.array_join(F.transform(calls, one), "\n"), F.lit(""))


def render_chatml(c: Column, generation_prompt: bool = False, full: bool = False, tools: Column | None = None, reasoning: bool = False) -> Column:
    """ChatML with reasoning kept only in turns after the last user query; null where the template would refuse:
    no user query, a system turn that isn't first, or an unknown role. full: messages have sanitised tool_calls as well;
    tools: JSON texts of the functions that may be called; reasoning: messages have reasoning_content, which goes before a trace in the content."""
    body = lambda m: T.strip(F.coalesce(m["content"], F.lit("")))
    query = lambda m: (m["role"] == "user") & ~(body(m).startswith("<tool_response>") & body(m).endswith("</tool_response>"))
    last = F.coalesce(F.array_max(F.transform(c, lambda m, i: F.when(query(m), i + 1).otherwise(0))), F.lit(0)) - 1

    def one(m: Column, i: Column) -> Column:
        b = body(m)
        has = b.contains("</think>")
        if reasoning:
            has = has & m["reasoning_content"].isNull()
        head = F.regexp_replace(F.split_part(b, F.lit("</think>"), F.lit(1)), r"\n+$", "")
        why = F.when(has, T.strip(F.element_at(F.split(head, "<think>"), -1))).otherwise(T.strip(F.coalesce(m["reasoning_content"], F.lit(""))) if reasoning else F.lit(""))
        said = F.when(has, F.regexp_replace(F.element_at(F.split(b, "</think>"), -1), r"^\n+", "")).otherwise(b)
        start = F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"))
        answer = F.when(i > last, F.concat(start, F.lit("<think>\n"), why, F.lit("\n</think>\n\n"), said)).otherwise(F.concat(start, said))
        if full:
            calls = tool_calls_text(m["tool_calls"])
            answer = F.concat(answer, F.when((calls != "") & (T.strip(said) != ""), F.lit("\n\n")).otherwise(""), calls)
        before, behind = F.get(c, i - 1)["role"], F.get(c, i + 1)["role"]
        tool = F.concat(
            F.when((i > 0) & (before != "tool"), F.lit("<|im_start|>user")).otherwise(""), F.lit("\n<tool_response>\n"), b, F.lit("\n</tool_response>"),
            F.when(behind.isNull() | (behind != "tool"), F.lit("<|im_end|>\n")).otherwise(""),
        )
        end = F.lit("<|im_end|>\n")
        plain = F.when(m["role"] == "assistant", F.concat(answer, end)).when(m["role"] == "tool", tool).otherwise(F.concat(start, b, end))
        return F.when((m["role"] == "system") & (i == 0), F.lit("")).otherwise(plain) if tools is not None else plain

    misplaced = F.exists(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda m: m["role"] == "system")
    unknown = F.exists(c, lambda m: ~F.coalesce(m["role"].isin("system", "user", "assistant", "tool"), F.lit(False)))
    out = F.array_join(F.transform(c, one), "")
    if tools is not None:
        first = F.get(c, F.lit(0))
        own = F.when(F.coalesce(first["role"] == "system", F.lit(False)), body(first)).otherwise("")
        listed = F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), "")
        some = F.concat(F.lit("<|im_start|>system\n" + _TOOLS_HEAD), listed, F.lit(_TOOLS_TAIL), F.when(own != "", F.concat(F.lit("\n\n"), own)).otherwise(""), F.lit("<|im_end|>\n"))
        none = F.when(F.coalesce(first["role"] == "system", F.lit(False)), F.concat(F.lit("<|im_start|>system\n"), own, F.lit("<|im_end|>\n"))).otherwise("")
        out = F.concat(F.when(F.size(tools) > 0, some).otherwise(none), out)
    if generation_prompt:
        out = F.concat(out, F.lit("<|im_start|>assistant\n<think>\n\n</think>\n\n"))
    return F.when((last >= 0) & ~F.coalesce(misplaced, F.lit(False)) & ~F.coalesce(unknown, F.lit(False)), out)


#: Preamble of the channel format.
HARMONY_SYSTEM = (
    "<|start|>system<|message|>You are ChatGPT, a large language model trained by OpenAI.\nKnowledge cutoff: 2024-06\nCurrent date: 2025-06-28\n\nReasoning: {}\n\n"
    "# Valid channels: analysis, commentary, final. Channel must be included for every message.<|end|>"
)


def render_harmony(c: Column, effort: str = "low") -> Column:
    """The channel format: an effort preamble unless the first turn sets one, and a system turn starts the text anew.
    Assistant turns without a channel go to final."""
    wrap = lambda head, m: F.concat(F.lit(head), F.coalesce(m["content"], F.lit("")), F.lit("<|end|>"))

    def one(m: Column) -> Column:
        r = m["role"]
        return (
            F.when(r == "system", wrap("<|start|>system<|message|>", m))
            .when(r == "user", wrap("<|start|>user<|message|>", m))
            .when(r == "assistant_analysis", wrap("<|start|>assistant<|channel|>analysis<|message|>", m))
            .when(r == "assistant_commentary", wrap("<|start|>assistant<|channel|>commentary<|message|>", m))
            .otherwise(wrap("<|start|>assistant<|channel|>final<|message|>", m))
        )

    from_ = F.greatest(last_index(c, "system"), F.lit(1))
    body = F.array_join(F.transform(F.slice(c, from_, F.greatest(F.size(c) - from_ + 1, F.lit(0))), one), "")
    return F.concat(F.when(last_index(c, "system") > 0, "").otherwise(HARMONY_SYSTEM.format(effort)), body)


def split_channels(content: Column) -> Column:
    """ARRAY<STRUCT<channel, message>> of a text in the channel format, stripped; one text entry where it has none."""
    p = F.lit(r"(?s)<\|channel\|>(.*?)<\|message\|>(.*?)<\|end\|>")
    names = F.transform(F.regexp_extract_all(content, p, F.lit(1)), T.strip)
    texts = F.transform(F.regexp_extract_all(content, p, F.lit(2)), T.strip)
    plain = F.array(F.struct(F.lit("text").alias("channel"), content.alias("message")))
    return F.when(F.size(names) > 0, F.transform(F.arrays_zip(names.alias("a"), texts.alias("b")), lambda z: F.struct(z["a"].alias("channel"), z["b"].alias("message")))).otherwise(plain)


def parse_tools(tools: Column) -> Column:
    """A tools value, JSON text of a list, as an array of JSON texts; anything else gives an empty list."""
    return F.coalesce(F.from_json(tools, "array<string>"), F.array().cast("array<string>"))


def route_request(body: Column) -> Column:
    """Struct (path, thinking) of a request body: chat if it has a list of messages, else completions. The flag comes
    from the keyword map, else from a top-level thinking, else it is off."""
    chat = F.get_json_object(body, "$.messages").startswith("[")
    inner, top = F.get_json_object(body, "$.chat_template_kwargs.enable_thinking"), F.get_json_object(body, "$.thinking")
    return F.when(F.coalesce(chat, F.lit(False)), F.struct(F.lit("/v1/chat/completions").alias("path"), F.coalesce(inner, top, F.lit("false")).alias("thinking"))).otherwise(
        F.struct(F.lit("/v1/completions").alias("path"), F.lit(None).cast("string").alias("thinking"))
    )


def wants_stream(body: Column) -> Column:
    """Whether a JSON object asks for a stream: any value but false, null, 0, empty text or an empty list."""
    v = F.get_json_object(body, "$.stream")
    return F.coalesce(~v.isin("false", "0", "", "[]", "{}", "0.0"), F.lit(False))


def stub_completion(prompt: Column) -> Column:
    """The stand-in for a teacher: a fixed head and the prompt's first 32 characters."""
    return F.concat(F.lit("stub:"), F.substring(F.coalesce(prompt, F.lit("")), 1, 32))


def dataset_prompt(kind: str, **cols: Column) -> Column:
    """Prompt text of the known benchmark kinds from their columns."""
    boxed = "\nPlease reason step by step, and put your final answer within \\boxed{}."
    if kind == "gsm8k":
        return F.concat(cols["question"], F.lit(boxed))
    if kind == "math500":
        return F.concat(cols["problem"], F.lit(boxed))
    if kind == "humaneval":
        return F.concat(F.lit("Write a solution to the following problem and make sure that it passes the tests:\n```python\n"), cols["prompt"], F.lit("\n```"))
    if kind in ("mbpp", "mt-bench"):
        return cols["prompt"]
    if kind == "longbench":
        return F.concat(T.first_words(cols["context"], 8192), F.lit("\n\n"), cols["question"])
    if kind in DATASETS:
        return DATASETS[kind](**cols)
    raise ValueError(f"unknown kind {kind!r}")


DATASETS: dict[str, Callable[..., Column]] = {}  # further kinds: name and builder of the prompt from its columns


def completion_text(body: Column) -> Column:
    """The answer in a response body: the first choice's text or message content, empty where there is none."""
    return F.coalesce(F.get_json_object(body, "$.choices[0].text"), F.get_json_object(body, "$.choices[0].message.content"), F.lit(""))


@dataclass(frozen=True)
class Template:
    name: str
    user: str
    assistant: str
    end: str
    system: str | None = None


class Templates:
    """Named chat templates; a name is taken once unless override is set."""

    def __init__(self) -> None:
        self._all: dict[str, Template] = {}

    def register(self, t: Template, override: bool = False) -> None:
        if t.name in self._all and not override:
            raise ValueError(f"template {t.name!r} is registered")
        self._all[t.name] = t

    def get(self, name: str) -> Template:
        return self._all[name]

    def names(self) -> list[str]:
        return sorted(self._all)

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, user, assistant, end, system), small enough to be broadcast: its size is the registry's."""
        return spark.createDataFrame([(t.name, t.user, t.assistant, t.end, t.system) for t in self._all.values()], "name STRING, user STRING, assistant STRING, end STRING, system STRING")


TEMPLATES = Templates()
for _t in (
    Template("chatml", "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n", DEFAULT_SYSTEM),
    Template("header", "<|start_header_id|>user<|end_header_id|>\n\n", "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"),
    Template("turn", "<start_of_turn>user\n", "<start_of_turn>model\n", "<end_of_turn>\n"),
    Template("plain", "USER: ", "ASSISTANT: ", "</s>"),
):
    TEMPLATES.register(_t)
