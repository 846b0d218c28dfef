"""Entities and relationships out of text units, by a pluggable backend; by rule where there is none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

#: A capitalised word of four letters or more, of any script; it names an entity where no model says better.
NAME = r"\p{Lu}\p{Ll}{3,}"
#: By rule a name is related to so many of the different names that follow it, wherever in a unit it stands. Pairs so grow
#: with the text, and not with its square.
WITHIN = 8
REPLY = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,rel_type:string,description:string,weight:double>>"


def names(c: Column) -> Column:
    """Different capitalised words in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(NAME), 0))


def rule_names() -> Column:
    """(name, type) in a list for each text unit by rule: RFC numbers, protocols, then capitalised words as CONCEPT."""
    # a function of one argument: to a second one Spark would give the place in the list
    typed = lambda values, kind: F.transform(values, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))
    rfc, protocol = X.rfc_mentions("raw_text"), F.transform(X.protocol_mentions("raw_text"), F.upper)
    return F.concat(*(typed(values, kind) for values, kind in ((rfc, "RFC"), (F.array_distinct(protocol), "PROTOCOL"), (names(F.col("raw_text")), "CONCEPT"))))


def rule_entities(units: DataFrame) -> DataFrame:
    """(name, type, description, text_unit_id, ord) of :func:`rule_names`, a row each."""
    rows = units.select(F.col("id").alias("text_unit_id"), "ord", F.posexplode(rule_names()).alias("at", "e"))
    return rows.select("e.name", "e.type", F.lit("").alias("description"), "text_unit_id", F.struct("ord", "at").alias("ord"))


def rule_relationships(units: DataFrame, within: int = WITHIN) -> DataFrame:
    """(source, target, rel_type, description, weight, text_unit_id, ord): each name of a unit with the ``within`` different
    names that follow it first, over all of its text."""
    each = units.select(F.col("id").alias("text_unit_id"), "ord", names(F.col("raw_text")).alias("all")).select("text_unit_id", "ord", "all", F.posexplode("all").alias("i", "source"))
    rows = each.select("text_unit_id", "ord", "i", "source", F.posexplode(F.slice("all", F.col("i") + 2, F.lit(within))).alias("j", "target"))
    return rows.select("source", "target", F.lit("RELATED_TO").alias("rel_type"), F.lit("").alias("description"), F.lit(1.0).alias("weight"), "text_unit_id", F.struct("ord", "i", "j").alias("ord"))


def ask_model(units: DataFrame, complete: Callable[[str], str], tries: int = 3) -> DataFrame:
    """(text_unit_id, ord, reply, status, error): a backend's reply for each unit, tried again if it fails. A unit that
    still fails is a row with its error, and stops no other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, o, text in zip(pdf["id"], pdf["ord"], pdf["raw_text"]):
                error = None
                for _ in range(tries):
                    try:
                        rows.append((i, o, complete(text), "done", None))
                        break
                    except Exception as e:  # a backend may fail in any way
                        error = f"{type(e).__name__}: {e}"
                else:
                    rows.append((i, o, None, "failed", error))
            yield pd.DataFrame(rows, columns=["text_unit_id", "ord", "reply", "status", "error"])

    kind = units.schema["ord"].dataType.simpleString()
    return units.select("id", "ord", "raw_text").mapInPandas(run, f"text_unit_id string, ord {kind}, reply string, status string, error string")


def parsed_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships in the replies, repaired where they are not plain JSON; nameless ones are left out."""
    rows = replies.where("status = 'done'").withColumn("r", X.repaired_json("reply", REPLY))
    entities = rows.select("text_unit_id", "ord", F.posexplode("r.entities").alias("at", "e")).select("e.*", "text_unit_id", F.struct("ord", "at").alias("ord"))
    relations = rows.select("text_unit_id", "ord", F.posexplode("r.relationships").alias("at", "e")).select("e.*", "text_unit_id", F.struct("ord", "at").alias("ord"))
    named = lambda c: F.coalesce(X.strip_ws(c), F.lit("")) != ""
    return entities.where(named("name")), relations.where(named("source") & named("target")).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def retried(units: DataFrame, complete: Callable[[str], str], rounds: int = 3) -> DataFrame:
    """Replies of all units; those that failed are asked again in later rounds, which touch no others."""
    from tessera.sources.scratch import saved

    done, left = None, units
    for _ in range(rounds + 1):
        replies = saved(ask_model(left, complete), "replies")
        done = replies if done is None else done.where("status = 'done'").unionByName(replies)
        failed = replies.where("status = 'failed'")
        if not failed.limit(1).count():
            break
        left = left.join(failed.select(F.col("text_unit_id").alias("id")), "id", "left_semi")
    return done
