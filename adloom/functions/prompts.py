"""Multi-line texts: user context, evidence blocks, chat prompts. Blank lines and fields are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.text import clean_text, is_placeholder_brand

# Labels and instructions of the prompts.
TASK = "根据以下用户搜索词和商品证据，生成一条真实、自然、简洁的中文广告文案。"
RULES = "生成约束：\n1. 不编造价格、折扣、销量。\n2. 不编造商品不存在的功效。\n3. 只输出一条 20~50 字中文广告文案。\n4. 语气自然，不要夸张营销。"
ONLY_COPY = "只输出文案本身，不要解释。"
AD_ROLE = "你是电商广告文案助手。\n请根据给定 query 和候选商品证据，输出一条简洁自然的中文广告文案。\n不要编造价格、优惠、销量、品牌承诺或不存在的商品卖点。\n优先使用商品标题、品牌、类目、店铺等显式信息。"
AD_OUTPUT = "Output:\n只输出一条中文广告文案，不要解释。"


def _labelled(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def user_context(profile: Column, titles: Column, limit: int = 5) -> Column:
    """Traits of the profile and recent titles, a line each; the province stands in for a missing city."""
    field = lambda c: clean_text(profile[c])
    place = F.coalesce(_labelled("城市：", field("city")), _labelled("地区：", field("province")))
    traits = F.concat_ws("，", _labelled("性别：", field("gender")), _labelled("年龄段：", field("age_bucket")), place)
    seen = F.array_distinct(F.filter(F.transform(F.coalesce(titles, F.array().cast("array<string>")), clean_text), lambda t: t != ""))
    return F.concat_ws("\n", _labelled("用户画像：", traits), _labelled("最近行为：", F.array_join(F.slice(seen, 1, limit), "；")))


def _numbered(items: Column, line) -> Column:
    lines = F.transform(items, lambda x, i: F.when(line(x) != "", F.concat((i + 1).cast("string"), F.lit(". "), line(x))))
    return F.array_join(F.array_compact(lines), "\n")


def evidence_block(items: Column) -> Column:
    def line(x: Column) -> Column:
        brand = clean_text(x["brand_name"])
        return F.concat_ws(
            " | ", F.nullif(clean_text(x["item_title"]), F.lit("")), F.when(~is_placeholder_brand(brand), _labelled("品牌：", brand)),
            _labelled("类目：", clean_text(x["category_path"])), _labelled("店铺：", clean_text(x["seller_name"])),
        )

    return _numbered(items, line)


def llm_evidence_block(items: Column) -> Column:
    names = {"item_title": "title=", "brand_name": "brand=", "seller_name": "seller=", "category_path": "category_path=", "ranking_signal": "ranking_signal=", "relevance_signal": "relevance_signal="}
    return _numbered(items, lambda x: F.concat_ws(" | ", *[_labelled(p, clean_text(x[c])) for c, p in names.items()]))


def _sections(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def ad_prompt(query: Column, profile: Column, titles: Column, items: Column) -> Column:
    return _sections(
        F.lit(AD_ROLE), F.concat(F.lit("Query:\n"), clean_text(query)), _labelled("User Context:\n", user_context(profile, titles)),
        _labelled("Evidence Items:\n", evidence_block(items)), F.lit(AD_OUTPUT),
    )


def chat_user_content(query: Column, profile: Column, titles: Column, items: Column) -> Column:
    return _sections(
        F.lit(TASK), F.concat(F.lit("query:\n"), clean_text(query)), _labelled("用户信息:\n", user_context(profile, titles)),
        _labelled("top-k 商品证据:\n", evidence_block(items)), F.lit(RULES), F.lit(ONLY_COPY),
    )
