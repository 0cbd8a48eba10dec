"""Text expressions: cleaning, name normalisation, similarity of names, prompts.

White space is an explicit class, as engines disagree about \\s.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Control characters and all of U+007F..U+00FF, which cleaning deletes.
DELETED = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xff]"
#: Company endings, dropped once each in this order.
ENDINGS = (r"inc\.?", r"corp\.?", r"ltd\.?", "llc", r"co\.?")

ENTITY_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "EVENT", "CONCEPT", "TECHNOLOGY", "PRODUCT", "DATE")
TUPLE_DELIMITER, RECORD_DELIMITER, COMPLETION_DELIMITER = "<|>", "##", "<|COMPLETE|>"

# Fixed text of the extraction prompt.
PROMPT_HEAD = """You are an AI assistant that helps extract entities and relationships from text for knowledge graph construction.

## Task
Extract entities and relationships from the provided text. Focus on the most important and relevant entities that would be valuable in a knowledge graph.

## Entity Types
Extract entities of these types: {types}

## Output Format
For each entity, provide:
(entity_name<|>entity_type<|>entity_description)##

For each relationship, provide:
(source_entity<|>relationship_type<|>target_entity<|>relationship_description)##

When you are finished, output the completion token: <|COMPLETE|>

## Guidelines
1. Entity names should be specific and descriptive.
2. Descriptions should be concise but informative.
3. Relationships should capture meaningful connections.
4. Use consistent naming (e.g., "John Smith" not "John" and "Smith" separately).
5. Focus on entities that are central to the text.
6. Adhere strictly to the output format.
7. Do not exceed a maximum of {most} entities per text.

## Text to Process:
"""
PROMPT_TAIL = "\n\n## Extracted Entities and Relationships:\n"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def clean_text(c: Column) -> Column:
    """White space is single spaces by then, so trimming spaces strips it."""
    return F.trim(F.regexp_replace(collapse(F.coalesce(c, F.lit(""))), DELETED, ""))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def normalize_name(c: Column) -> Column:
    """The merging normaliser: lower case, no company endings, no punctuation but dots."""
    out = strip(F.lower(c))
    for ending in ENDINGS:
        out = F.regexp_replace(out, f"[{SPACE}]+{ending}$", "")
    return strip(collapse(F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_{SPACE}.]", "")))


def normalize_entity_name(c: Column) -> Column:
    """The relationship normaliser: lower case, single spaces, no leading article."""
    return F.regexp_replace(collapse(strip(F.lower(c))), "^(the )?(a )?(an )?", "")


def words(c: Column) -> Column:
    """The distinct words between white space."""
    return F.array_distinct(F.filter(F.split(collapse(strip(c)), " "), lambda w: w != ""))


def norm_similarity(a: Column, b: Column) -> Column:
    """1 for equal normal names, 0.9 if one holds the other, else the Jaccard similarity of their words."""
    common, every = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.9).otherwise(F.coalesce(F.try_divide(common.cast("double"), every.cast("double")), F.lit(0.0)))


def name_similarity(a: Column, b: Column) -> Column:
    return norm_similarity(normalize_name(a), normalize_name(b))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_to(a: Column, query: Column, size: int, norm: float) -> Column:
    """cosine with one vector of known size and norm."""
    value = F.try_divide(_dot(a, query), F.sqrt(_dot(a, a)) * F.lit(norm))
    return F.coalesce(F.when(F.size(a) == size, value), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for a missing, empty or zero vector and for vectors of two sizes."""
    value = F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    return F.coalesce(F.when(F.size(a) == F.size(b), value), F.lit(0.0))


def clamped_cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), cosine(a, b))


def extraction_prompt(text: Column, types=ENTITY_TYPES, most: int = 20) -> Column:
    head = PROMPT_HEAD.replace("{types}", ", ".join(types)).replace("{most}", str(most))
    return F.concat(F.lit(head), text, F.lit(PROMPT_TAIL))


def entity_text(name: Column, description: Column) -> Column:
    """What is embedded for an entity."""
    return F.concat(name, F.lit(": "), F.coalesce(description, F.lit("")))
