"""Local names in Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: a long chain of rewrites stays linear in size."""
    return F.element_at(F.transform(F.array(value), body), 1)


@dataclass(frozen=True)
class Rule:
    """A rewrite of all matches of a Java pattern. needs: literals of which each match holds one, so that a text without
    any of them is left alone by a cheap search."""

    issue: str
    pattern: str
    replacement: str
    needs: tuple[str, ...] = ()


def present(text: Column, literals: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(x) for x in literals)) if literals else F.lit(True)


def rewrite(text: Column, rules: list[Rule], issues: list[str]) -> Column:
    """struct<text, one int per issue>: each rule on the result of the one before, its matches counted on what it is given."""
    state = F.struct(text.alias("text"), *[F.lit(0).alias(i) for i in issues])

    def step(rule: Rule) -> Callable[[Column], Column]:
        def apply(s: Column) -> Column:
            done = F.struct(
                F.regexp_replace(s["text"], F.lit(rule.pattern), F.lit(rule.replacement)).alias("text"),
                *[(s[i] + F.regexp_count(s["text"], F.lit(rule.pattern)) if i == rule.issue else s[i]).alias(i) for i in issues],
            )
            return F.when(present(s["text"], rule.needs), done).otherwise(s) if rule.needs else done

        return apply

    for rule in rules:
        state = let(state, step(rule))
    return state
