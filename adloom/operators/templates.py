"""Template candidates: a small table of sentences by vertical and strategy, filled in for a whole table of queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions import lexicons as L
from adloom.functions.text import HAN, clean_text, tokens
from adloom.operators.candidates import drop_redundant_tail, sanitize_copy
from adloom.operators.understanding import keep_distinct


def vertical_table(spark: SparkSession) -> DataFrame:
    """One row a vertical: scene, audience, default_points, preferred_points, ending."""
    rows = [(name, scene, audience, *map(list, L.VERTICAL_POINTS[name]), L.ENDINGS[name]) for name, _, scene, audience in L.VERTICALS]
    return spark.createDataFrame(rows, "vertical string, scene string, default_audience string, default_points array<string>, preferred_points array<string>, ending string")


def template_table(spark: SparkSession) -> DataFrame:
    """vertical, strategy, place (from 0), sentence."""
    rows = [(name, strategy, i, text) for name, sentences in L.SENTENCES.items() for i, (strategy, text) in enumerate(zip(L.STRATEGIES, sentences, strict=True))]
    return spark.createDataFrame(rows, "vertical string, strategy string, place int, sentence string")


def vertical_of(text: Column) -> Column:
    out = F.lit("misc")
    for name, words, *_ in reversed([v for v in L.VERTICALS if v[1]]):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), name).otherwise(out)
    return out


def query_term(query: Column) -> Column:
    """The special query that the text contains, else its first token of two characters, else the text."""
    special = F.coalesce(*[F.when(F.contains(query, F.lit(s[0])), F.lit(s[0])) for s in L.SPECIAL_QUERIES])
    long = F.filter(tokens(query, "mixed"), lambda t: F.char_length(t) >= 2)
    return F.coalesce(special, F.get(long, F.lit(0)), clean_text(query))


def _points(listed: Column, focus: Column, default: Column, preferred: Column) -> Column:
    """At most four points: those that the listed points and the focus name, the vertical's preferred ones first."""
    words = F.array(*map(F.lit, L.POINT_WORDS))

    def named(p: Column) -> Column:
        found = F.filter(words, lambda w: F.contains(clean_text(p), w))
        return F.when(F.size(found) > 0, found).otherwise(F.array(clean_text(p)))

    given = F.filter(F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.filter(tokens(focus, "mixed"), lambda t: F.char_length(t) >= 2)), lambda p: clean_text(p) != "")
    found = F.filter(F.flatten(F.transform(given, named)), lambda p: (F.char_length(p) >= 2) & ~p.isin(*L.NO_POINTS))
    kept = F.slice(F.array_distinct(F.when(F.size(found) > 0, found).otherwise(default)), 1, 4)
    liked = F.filter(preferred, lambda p: F.array_contains(kept, p))
    liked = F.when(F.size(liked) > 0, liked).otherwise(F.slice(preferred, 1, 2))
    return F.slice(F.array_distinct(F.concat(liked, kept)), 1, 4)


def _pieces(text: Column) -> Column:
    """Pieces of two and three characters with a Han character."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    some = lambda n: F.when(F.char_length(text) >= n, cut(n)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(some(2), some(3)), lambda p: p.rlike(f"[{HAN}]"))


def _ended(text: Column, ending: Column) -> Column:
    once = sanitize_copy(text)
    return F.when(F.char_length(once) >= 12, once).otherwise(sanitize_copy(F.concat(F.rtrim(once, F.lit("。")), ending)))


def template_drafts(queries: DataFrame, count: int = 5, strategies: Sequence[str] = L.STRATEGIES, templates: DataFrame | None = None) -> DataFrame:
    """query, candidate_id, strategy, vertical, draft, point_a, point_b, used_evidence, personalized_tags, scenario, ending: the
    filled sentences, not yet cleaned.

    queries: query, category_hint, titles (array), scenario, audience, purchase_focus, points, interest_tags,
    demographic_tags. A query names its vertical by the first that has a word in query, category or titles; it then meets
    the verticals and the sentences of `count` strategies (3 to 5) by equality. A draft that names neither query, scene
    nor audience begins with the scene. Nulls count as empty.
    """
    spark = queries.sparkSession
    templates = template_table(spark) if templates is None else templates
    texts = {c: clean_text(F.col(c)) for c in ("query", "category_hint", "scenario", "audience", "purchase_focus")}
    none = F.array().cast("array<string>")
    about = queries.select(
        *[x.alias(c) for c, x in texts.items()], *[F.coalesce(c, none).alias(c) for c in ("titles", "points", "interest_tags", "demographic_tags")]
    )
    words = F.concat_ws(" ", "query", "category_hint", F.array_join("titles", " "))
    rows = about.withColumn("vertical", vertical_of(words)).join(vertical_table(spark), "vertical")
    rows = rows.select(
        "query", "vertical", "ending", query_term(F.col("query")).alias("term"), F.coalesce(F.nullif("scenario", F.lit("")), "scene").alias("scenario"),
        F.coalesce(F.nullif("audience", F.lit("")), "default_audience").alias("audience"), "interest_tags", "demographic_tags",
        _points(F.col("points"), F.col("purchase_focus"), F.col("default_points"), F.col("preferred_points")).alias("points"),
    )
    wanted = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(s).alias("strategy")) for i, s in enumerate(strategies[: max(3, min(count, 5))])])
    rows = rows.select("*", F.inline(wanted)).join(templates.select("vertical", "strategy", "sentence"), ["vertical", "strategy"])
    # one strategy moves on through the points, the others use the first two
    moving, n = F.col("strategy") == L.STRATEGIES[1], F.size("points")
    at = lambda i: F.get("points", i)
    first, second = F.when(moving, F.col("turn") % n).otherwise(0), F.when(moving, (F.col("turn") + 1) % n).otherwise(F.least(n - 1, F.lit(1)))
    rows = rows.withColumn("point_a", at(first)).withColumn("point_b", at(second))
    both = F.when(F.col("point_b") != F.col("point_a"), F.concat("point_a", "point_b")).otherwise(F.col("point_a"))
    draft = F.col("sentence")
    for mark, value in (("{ab}", both), ("{s}", F.col("scenario")), ("{u}", F.col("audience")), ("{q}", F.col("term")), ("{a}", F.col("point_a")), ("{b}", F.col("point_b")), ("{o}", F.col("point_b"))):
        draft = F.replace(draft, F.lit(mark), value)
    rows = rows.withColumn("draft", draft)
    core = [F.slice(tokens(F.col(c), "mixed"), 1, 3) for c in ("term", "scenario", "audience")] + [_pieces(F.col(c)) for c in ("term", "scenario", "audience")]
    core = F.concat(*core, F.array(*map(F.lit, L.NATURAL_SCENES)))
    named = F.exists(core, lambda t: (t != "") & F.contains(F.col("draft"), t))
    return rows.select(
        "query", F.concat(F.lit("tpl_"), (F.col("turn") + 1).cast("string")).alias("candidate_id"), "strategy", "vertical",
        F.when(named, F.col("draft")).otherwise(F.concat("scenario", "draft")).alias("draft"), "point_a", "point_b",
        F.slice(keep_distinct(F.array("point_a", "point_b")), 1, 2).alias("used_evidence"),
        F.slice(keep_distinct(F.concat("interest_tags", "demographic_tags", F.array("audience"))), 1, 3).alias("personalized_tags"), "scenario", "ending",
    )


def template_candidates(queries: DataFrame, count: int = 5, templates: DataFrame | None = None) -> DataFrame:
    """query, candidate_id, text, strategy, used_evidence, personalized_tags, rationale: cleaned drafts (see template_drafts), of
    12 characters at least; one of the last vertical names a point."""
    rows = template_drafts(queries, count, templates=templates)
    rows = rows.withColumn("text", drop_redundant_tail(_ended(F.col("draft"), F.col("ending"))))
    silent = (F.col("vertical") == "misc") & ~F.contains("text", "point_a") & ~F.contains("text", "point_b")
    added = F.concat(F.rtrim("text", F.lit("。")), F.lit("，"), "point_a", F.lit("更对路"))
    text = F.when(silent, drop_redundant_tail(_ended(added, F.col("ending")))).otherwise(F.col("text"))
    both = F.when(F.col("point_b") != F.col("point_a"), F.concat("point_a", "point_b")).otherwise(F.col("point_a"))
    why = F.concat(F.lit("结合"), "strategy", F.lit("表达，落到"), "scenario", F.lit("和"), both, F.lit("。"))
    return rows.select("query", "candidate_id", text.alias("text"), "strategy", "used_evidence", "personalized_tags", why.alias("rationale"))
