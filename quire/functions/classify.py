"""What a span or a recognised line is: title, heading, list item or paragraph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BULLETS, DIGIT, WS, is_upper, strip

NUMBERED = rf"(?d)\A({DIGIT}+(?:\.{DIGIT}+)*){WS}+(.+)\z"
BULLETED = rf"\A[{BULLETS}*-]{WS}+"
ENUMERATED = rf"\A{DIGIT}+[.)]{WS}+"
LETTERED = rf"\A[A-Za-z][.)]{WS}+"


@dataclass(frozen=True)
class Sizes:
    """Font sizes at which text is a title or a heading, and the size of body text."""

    title: float = 16.0
    heading: float = 12.0
    body: float = 10.0


def is_list_item(text: Column) -> Column:
    return text.rlike(BULLETED) | text.rlike(ENUMERATED) | text.rlike(LETTERED)


def section_number(text: Column) -> Column:
    """``2.3`` of ``2.3 Some words``, else null."""
    found = F.regexp_extract(text, NUMBERED, 1)
    return F.when(found != "", found)


def number_level(number: Column, most: int | None = 6) -> Column:
    depth = F.size(F.split(number, r"\."))
    return F.least(depth, F.lit(most)) if most else depth


def size_level(size: Column, at: Sizes) -> Column:
    return (
        F.when(size >= at.title, 1).when(size >= at.heading + 4, 2).when(size >= at.heading + 2, 3).when(size >= at.heading, 4).otherwise(5)
    )


def classify_span(text: Column, size: Column, bold: Column, at: Sizes = Sizes()) -> Column:
    """(type, text, level, section_number) of a native span; the first rule that holds decides."""
    text = strip(text)
    n, number = F.length(text), section_number(text)
    title = (size >= at.title) | (is_upper(text) & bold & (n > 5)) | (bold & (n < 100))
    heading = ((size >= at.heading) & (size > at.body)) | (bold & (n > 5) & (n < 100))

    def out(kind, level, section=None):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), level.cast("int").alias("level"), (F.lit(None) if section is None else section).cast("string").alias("section_number"))

    return (
        F.when(is_list_item(text), out("list_item", F.lit(1)))
        .when(title, out("title", F.lit(1)))
        .when(number.isNotNull(), out("heading", number_level(number), number))
        .when(heading, out("heading", size_level(size, at)))
        .otherwise(out("paragraph", F.lit(None)))
    )


def classify_line(text: Column) -> Column:
    """(type, text, level) of a recognised line, which has neither size nor style."""
    text = strip(text)
    n, number = F.length(text), section_number(text)

    def out(kind, level):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), level.cast("int").alias("level"))

    return (
        F.when(number.isNotNull(), out("heading", number_level(number, None)))
        .when(text.rlike(BULLETED) | text.rlike(ENUMERATED), out("list_item", F.lit(None)))
        .when(is_upper(text) & (n > 5) & (n < 100), out("heading", F.lit(2)))
        .otherwise(out("paragraph", F.lit(None)))
    )
