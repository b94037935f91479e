"""Outside models behind two interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X

#: Texts to vectors, and prompts to answers: called once per batch, results in order.
Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[list[str]], list[str]]
#: Conversations, each a list of (role, content), and a temperature, to answers.
ChatModel = Callable[[list[list[tuple[str, str]]], float], list[str]]


def hashed_vector(text: Column, dimensions: int = 64) -> Column:
    """A unit vector from the terms of a text: each adds 1 or -1 at a place by its hash. All zero for a text without terms."""
    places = F.transform(X.terms(text), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dimensions)).alias("i"), F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(F.filter(places, lambda p: p["i"] == i), F.lit(0.0), lambda s, p: s + p["v"]))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(norm(raw) > 0, x / norm(raw)).otherwise(0.0).cast("float"))


def embed(rows: DataFrame, column: str, model: Embedder | None = None, batch: int = 500) -> DataFrame:
    """The rows with an embedding of ``column``: by ``model``, in batches, or else the hashed one."""
    if model is None:
        return rows.withColumn("embedding", hashed_vector(F.col(column)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = [t or "" for t in pdf[column]]
            yield pdf.assign(embedding=[v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])])

    return rows.mapInPandas(run, _ddl(rows) + ", embedding array<float>")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def extract(prompts: list[str]) -> list[str]:
    """The stand-in for a chat model: the first sentence of the first source in the context, cited."""
    out = []
    for p in prompts:
        body = (p or "").partition("Content: ")[2].split("\n")[0]
        sentence = body.split(". ")[0].strip()
        out.append(f"{sentence}.\n\nCited Source Indices: 0" if sentence else "I cannot find that information.")
    return out


def generate(rows: DataFrame, column: str, models: list[Generator] | None = None, batch: int = 50) -> DataFrame:
    """The rows with an ``answer`` to the prompt in ``column``: from the first model of the list that answers a batch; if none does, what went wrong."""
    chain = models or [extract]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            answers: list[str] = []
            for i in range(0, len(pdf), batch):
                prompts, problem = list(pdf[column].iloc[i : i + batch]), "no model"
                for model in chain:
                    try:
                        answers += model(prompts)
                        break
                    except Exception as e:
                        problem = str(e)
                else:
                    answers += [f"Error: {problem}"] * len(prompts)
            yield pdf.assign(answer=answers)

    return rows.mapInPandas(run, _ddl(rows) + ", answer string")


def as_roles(messages: Column) -> Column:
    """An array of structs (role, content) with the roles that a chat model knows: assistant for ai and assistant, system, and user for all others."""
    role = lambda m: F.lower(F.trim(m["role"]))
    return F.transform(messages, lambda m: F.struct(F.when(role(m).isin("ai", "assistant"), "assistant").when(role(m) == "system", "system").otherwise("user").alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))


def chat(rows: DataFrame, messages: str, temperature: str, models: list[ChatModel] | None = None, batch: int = 50) -> DataFrame:
    """The rows with an ``answer`` to the conversation in ``messages`` at their ``temperature``: from the first model of the list that answers a batch.

    A batch holds conversations of one temperature. If no model answers, the answer is what went wrong. Without models the stand-in reads the last message.
    """
    chain = models or [lambda talks, _: extract([t[-1][1] if t else "" for t in talks])]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            answers: dict = {}
            for heat, part in pdf.groupby(temperature, dropna=False):
                for i in range(0, len(part), batch):
                    some = part.iloc[i : i + batch]
                    talks, problem = [[(m["role"], m["content"]) for m in t] for t in some[messages]], "no model"
                    for model in chain:
                        try:
                            answers |= dict(zip(some.index, model(talks, float(heat)), strict=True))
                            break
                        except Exception as e:
                            problem = str(e)
                    else:
                        answers |= dict.fromkeys(some.index, f"Error: {problem}")
            yield pdf.assign(answer=[answers[i] for i in pdf.index]).drop(columns=[messages])

    return rows.mapInPandas(run, _ddl(rows.drop(messages)) + ", answer string")
