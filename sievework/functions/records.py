"""Records of any chat or instruction format as prompt, response and text; prompts of benchmarks; answers read from text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed texts of the formats.
WITH_INPUT = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request."
WITHOUT_INPUT = "Below is an instruction that describes a task. Write a response that appropriately completes the request."
STEP_BY_STEP = "Solve the following math problem step by step. Show your reasoning and end with '#### <answer>'.\n\n"
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"


def filled(c: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(c, F.lit(""))


def alpaca(df: DataFrame) -> DataFrame:
    """instruction, input, output -> prompt, response, text. An empty or null input takes the form without one."""
    ask = F.concat(F.lit("\n\n### Instruction:\n"), filled(F.col("instruction")))
    given = F.concat(F.lit("\n\n### Input:\n"), F.col("input"))
    end = F.lit("\n\n### Response:\n")
    prompt = F.when(F.length("input") > 0, F.concat(F.lit(WITH_INPUT), ask, given, end)).otherwise(F.concat(F.lit(WITHOUT_INPUT), ask, end))
    return df.withColumns({"prompt": prompt, "response": filled(F.col("output"))}).withColumn("text", F.concat("prompt", "response"))


def _turns(form: Callable[[Column], Column], messages: str) -> Column:
    return F.array_join(F.transform(messages, form), "")


def _first_answer(messages: str, roles: tuple[str, ...]) -> Column:
    said = F.filter(messages, lambda m: m["role"].isin(*roles) & (F.length(m["content"]) > 0))
    return filled(F.get(said, F.lit(0))["content"])


def sharegpt(df: DataFrame, messages: str = "messages", strict: bool = False) -> DataFrame:
    """Turns (role, content) -> prompt, response, text. All assistant turns are part of the prompt, as the format has it;
    with ``strict`` the prompt ends where the response begins."""
    human, bot = ("human", "user"), ("gpt", "assistant")

    def form(m: Column) -> Column:
        said = F.concat(filled(m["content"]), F.lit("\n"))
        return F.when(m["role"].isin(*human), F.concat(F.lit("### Human:\n"), said)).when(m["role"].isin(*bot), F.concat(F.lit("### Assistant:\n"), said)).otherwise("")

    return _chat(df, messages, form, bot, F.col("prompt"), strict, "### Assistant:\n")


def chatml(df: DataFrame, messages: str = "messages", strict: bool = False) -> DataFrame:
    """Turns (role, content) -> prompt, response, text, in tags; the text has the response once more at its end."""

    def form(m: Column) -> Column:
        role = F.coalesce(m["role"], F.lit("user"))
        said = F.concat(F.lit("<|"), role, F.lit("|>\n"), filled(m["content"]), F.lit("<|end|>\n"))
        return F.when(role.isin("system", "user", "assistant"), said).otherwise("")

    tail = F.when(F.length("response") > 0, F.concat(F.lit("<|assistant|>\n"), "response", F.lit("<|end|>"))).otherwise("")
    return _chat(df, messages, form, ("assistant",), F.concat("prompt", tail), strict, "<|assistant|>\n")


def _chat(df, messages, form, roles, text: Column, strict: bool, opening: str) -> DataFrame:
    if strict:
        at = F.array_position(F.transform(messages, lambda m: m["role"].isin(*roles) & (F.length(m["content"]) > 0)), True).cast("int")
        before = F.when(at > 0, F.slice(F.col(messages), F.lit(1), at - 1)).otherwise(F.col(messages))
        df = df.withColumn("response", _first_answer(messages, roles)).withColumn("__before", before)
        prompt = F.concat(_turns(form, "__before"), F.when(at > 0, F.lit(opening)).otherwise(""))
        return df.withColumn("prompt", prompt).withColumn("text", F.concat("prompt", "response")).drop("__before")
    return df.withColumns({"prompt": _turns(form, messages), "response": _first_answer(messages, roles)}).withColumn("text", text)


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {"alpaca": alpaca, "sharegpt": sharegpt, "chatml": chatml}


def normalize(df: DataFrame, template: str) -> DataFrame:
    """By the template's name; an unknown one leaves the rows as they are."""
    return df.transform(NORMALIZERS[template]) if template in NORMALIZERS else df


def validation_text(df: DataFrame) -> Column:
    """The first of text, question, instruction and prompt that is there and not empty; with an answer, question and answer."""
    has = [c for c in ("text", "question", "instruction", "prompt") if c in df.columns]
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in has], F.lit(""))
    if "answer" not in df.columns:
        return text
    question = filled(F.col("question")) if "question" in df.columns else F.lit("")
    return F.when(F.length("answer") > 0, F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), "answer")).otherwise(text)


def pool_text(df: DataFrame) -> Column:
    """What n-gram features are made from: prompt where there is such a column, else text, else nothing."""
    return next((filled(F.col(c)) for c in ("prompt", "text") if c in df.columns), F.lit(""))


def choice_prompt(question: Column, choices: Column) -> Column:
    """A question with at most four lettered choices."""
    four = F.slice(choices, 1, 4)
    letters = F.slice(F.array(*map(F.lit, "ABCD")), F.lit(1), F.size(four))
    lines = F.zip_with(letters, four, lambda a, b: F.concat(a, F.lit(". "), filled(b), F.lit("\n")))
    return F.concat(F.lit("Question: "), question, F.lit("\n\n"), F.array_join(lines, ""), F.lit("\nAnswer:"))


def math_prompt(question: Column, step_by_step: bool = True) -> Column:
    if step_by_step:
        return F.concat(F.lit(STEP_BY_STEP + "Question: "), question, F.lit("\n\nLet's solve this step by step:\n"))
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def final_number(text: Column) -> Column:
    """The number after the first ####, else the last number; without any, null."""
    marked = F.nullif(F.regexp_extract(text, rf"####\s*({NUMBER})", 1), F.lit(""))
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), F.lit(-1))
    return F.replace(F.coalesce(marked, last), F.lit(","), F.lit("")).try_cast("double")


def best_choice(scores: Column) -> Column:
    """The place, from 0, of the largest score; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
