"""Row types of the library's tables, as DDL."""

from __future__ import annotations

ITEM = "item_id bigint, item_title string, brand_name string, seller_name string, category_path string"
USER = "user_id bigint, gender string, age_bucket string, city string, province string, country string"
LOG = (
    "seq string, query string, user_id bigint, session_id bigint, item_id bigint, is_clicked bigint, is_purchased bigint,"
    " show_cnt bigint, click_cnt bigint, order_cnt bigint, recently_clicked_item_ids array<bigint>,"
    " recently_purchased_item_ids array<bigint>, split string"
)
EVIDENCE = (
    "item_id bigint, item_title string, brand_name string, seller_name string, category_path string, purchase_cnt bigint,"
    " click_cnt bigint, ranking_signal double, relevance_signal int"
)
#: Raw JSON lines: every scalar is read as text and coerced afterwards, under all the names it may have.
RAW_ITEM = ", ".join(
    (
        f"{c} string"
        for c in (
            "item_id", "target_item_id", "item_title", "title", "item_name", "name", "brand_name", "brand", "seller_name",
            "seller", "shop_name", "category_path", "category_level1_name", "category_l1_name", "category1_name",
            "category_level2_name", "category_l2_name", "category2_name", "category_level3_name", "category_l3_name",
            "category3_name", "category_level1_id", "category_level2_id", "category_level3_id",
        )
    )
)
RAW_USER = ", ".join(
    (f"{c} string" for c in ("user_id", "gender", "age_bucket", "age", "fre_city", "city", "fre_province", "province", "fre_country", "country"))
)
RAW_LOG = (
    "query string, user_id string, session_id string, target_item_id string, item_id string, is_clicked string,"
    " is_purchased string, target_item_statistical_features struct<item_show_cnt_30d_hist string,"
    " item_click_cnt_30d_hist string, item_order_cnt_30d_hist string>, recently_clicked_item_ids array<string>,"
    " recently_purchased_item_ids array<string>, split string"
)
