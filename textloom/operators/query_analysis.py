"""Query understanding: normal form, language, intent, entities, topic, filters. Columns over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.functions import text as T


def _has(c: Column, source: str, flags: str = "") -> Column:
    return c.rlike(T.pattern(source, flags))


def normalize(query: Column) -> Column:
    """Abbreviations written out, the region's name added where it is missing."""
    c = T.trim(T.text_or_empty(query))
    for source, name in rules.ABBREVIATIONS:
        c = F.regexp_replace(c, F.lit(T.pattern(source, "i")), F.lit(name))
    return T.trim(F.when(F.lower(c).contains(rules.REGION_WORD), c).otherwise(F.concat(c, F.lit(rules.REGION_SUFFIX))))


def intent(query: Column) -> Column:
    c = T.trim(T.text_or_empty(query))
    chat = (c == "") | _has(c, rules.GREETING, "i") | _has(c, rules.THANKS, "i") | F.lower(c).isin(rules.SMALL_TALK)
    fact = _has(c, rules.SIMPLE_FACT, "i") & (T.word_count(c) <= rules.SIMPLE_FACT_WORDS)
    return F.when(chat, "conversational").when(_has(c, rules.GENERAL, "i"), "general_knowledge").when(fact, "simple_fact").otherwise("rag_query")


def thanks(query: Column) -> Column:
    return _has(T.text_or_empty(query), rules.THANKS_REPLY, "i")


def _topic(low: Column, topics: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(_has(low, p), name) for name, p in topics])


def _extended(query: Column, entities: Column, topic: Column, *more: Column) -> Column:
    return T.trim(F.concat_ws(" ", normalize(query), F.nullif(F.array_join(entities, " "), F.lit("")), topic, *more))


def analyze_v1(queries: DataFrame, query: str = "query") -> DataFrame:
    """Every office named is an entity, the last of them a filter; the district is always one."""
    q = F.col(query)
    low = F.lower(T.text_or_empty(q))
    named = [F.when(_has(low, p), name) for name, p in rules.OFFICES]
    entities = F.array_compact(F.array(*named))
    topic = _topic(low, rules.TOPICS_V1)
    pairs = [("district", F.lit(rules.DISTRICT)), ("office", F.coalesce(*named[::-1])), ("document_type", F.when(topic == "contact", "contact")), ("topic", topic)]
    filters = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda k, v: v.isNotNull())
    return queries.select("*", T.query_language(T.trim(q)).alias("language"), intent(q).alias("intent"), topic.alias("topic"), entities.alias("entities"), filters.alias("filters"), _extended(q, entities, topic).alias("retrieval_query"))


def analyze_v2(queries: DataFrame, query: str = "query") -> DataFrame:
    """The first office named is the entity and the only filter; procedures get expansion words."""
    q = F.col(query)
    low = F.lower(T.text_or_empty(q))
    office = F.coalesce(*[F.when(_has(low, p), name) for name, p in rules.OFFICES])
    entities = F.array_compact(F.array(office))
    topic = _topic(low, rules.TOPICS_V2)
    filters = F.when(office.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("office"), office))
    more = F.when(topic == "procedure", rules.PROCEDURE_EXPANSION)
    return queries.select("*", T.query_language(T.trim(q)).alias("language"), intent(q).alias("intent"), topic.alias("topic"), entities.alias("entities"), filters.alias("filters"), _extended(q, entities, topic, more).alias("retrieval_query"))


def message(table: dict[str, str], language: Column) -> Column:
    """The message of a language; English where there is none."""
    c = F.lit(table["en"])
    for name, value in table.items():
        c = F.when(language == name, value).otherwise(c)
    return c


def small_talk(query: Column, language: Column) -> Column:
    return F.when(thanks(query), message(rules.THANKED, language)).otherwise(message(rules.CONVERSATIONAL, language))
