"""Copy texts made from evidence fields. Sentences are the library's defaults for Chinese search ads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.text import clean_text, is_placeholder_brand, leaf_category, title_contains_brand

# Template sentences by what is present.
WITH_SELLER = "搜“{query}”可以先看这款{title}，由{seller}在售，信息清楚，适合先了解。"
WITH_CATEGORY = "搜“{query}”可先关注这款{title}，属于{category}方向，和当前需求更贴近。"
WITH_TITLE = "结合你搜索的“{query}”，这款{title}是当前更匹配的选择，信息直观，适合优先浏览。"
CATEGORY_ONLY = "结合你搜索的“{query}”，可先关注{category}方向的候选商品，便于更快缩小选择范围。"
QUERY_ONLY = "结合你搜索的“{query}”，推荐先查看当前匹配度更高的商品证据，快速缩小选择范围。"
# Summary sentences by what the evidence shares.
SUMMARY_BRAND_LEAF = "搜“{query}”时，可先关注{brand}{leaf}方向，当前候选主要集中在这类商品，便于更快缩小选择范围。"
SUMMARY_MAJOR = "搜“{query}”时，当前候选主要集中在{major}下的{leaf}方向，建议先从这类商品里继续筛选。"
SUMMARY_MAJORITY = "结合“{query}”的搜索意图，当前证据更多落在{major}相关商品上，可优先关注这一类方向。"
SUMMARY_TITLE = "搜“{query}”时，当前候选多围绕“{hint}”相关商品，可先从这一方向继续筛选。"
# Creative sentences.
CREATIVE_TITLE = "想找“{query}”？不妨先看{hint}相关款，更容易挑到顺眼又合用的一款。"
CREATIVE_CATEGORY = "围绕“{query}”这类需求，不妨先看{category}相关款，更容易找到贴合场景的选择。"
CREATIVE_ITEM = "想找“{query}”？不妨先看看更贴合这类需求的相关款，更容易挑到顺手的一款。"
CREATIVE_NONE = "围绕“{query}”的需求，可以先看更贴近搜索意图的相关款式。"


def fill(sentence: str, **values: Column) -> Column:
    """The sentence with its {names} replaced by columns."""
    parts, rest = [], sentence
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def template_copy(query: Column, title: Column, brand: Column, seller: Column, path: Column) -> Column:
    """A sentence about one item. The brand leads the title unless it is a placeholder or already in it."""
    query, title, brand, seller, path = map(clean_text, (query, title, brand, seller, path))
    use = ~is_placeholder_brand(brand) & ~title_contains_brand(title, brand)
    shown = F.when(use & (title != ""), F.concat(brand, title)).otherwise(title)
    category = leaf_category(path)
    values = {"query": query, "title": shown, "seller": seller, "category": category}
    return (
        F.when((shown != "") & (seller != ""), fill(WITH_SELLER, **values))
        .when((shown != "") & (category != ""), fill(WITH_CATEGORY, **values))
        .when(shown != "", fill(WITH_TITLE, **values))
        .when(category != "", fill(CATEGORY_ONLY, **values))
        .otherwise(fill(QUERY_ONLY, **values))
    )


# Sentences of the conservative copy, and the marks that a cut copy loses at its end.
CAUTIOUS_SELLER = "围绕“{query}”，可先看看这款{title}，由{seller}在售，信息更直观。"
CAUTIOUS_TITLE = "围绕“{query}”，可先看看这款{title}，更贴近当前搜索需求。"
CAUTIOUS_CATEGORY = "围绕“{query}”，建议先关注{category}方向的候选商品。"
CAUTIOUS_QUERY = "围绕“{query}”，建议先关注当前更匹配的候选商品方向。"
CUT_MARKS = "，。；、 "


def cut_copy(text: Column, limit: int = 50) -> Column:
    """White space collapsed; a text over the limit is cut one short of it, loses marks at its end and gets a full stop."""
    flat = F.regexp_replace(clean_text(text), r"(?U)\s+", " ")
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit - 1)), F.lit(CUT_MARKS)), F.lit("。")))


def conservative_copy(query: Column, title: Column, seller: Column, path: Column, limit: int = 50) -> Column:
    """The sentence for when no text was generated: about the first item, its category, or the query alone."""
    query, title, seller, category = clean_text(query), clean_text(title), clean_text(seller), leaf_category(path)
    values = {"query": query, "title": title, "seller": seller, "category": category}
    made = (
        F.when((title != "") & (seller != ""), fill(CAUTIOUS_SELLER, **values))
        .when(title != "", fill(CAUTIOUS_TITLE, **values))
        .when(category != "", fill(CAUTIOUS_CATEGORY, **values))
        .otherwise(fill(CAUTIOUS_QUERY, **values))
    )
    return cut_copy(made, limit)
