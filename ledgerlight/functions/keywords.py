"""Fixed values of the role rules.

The word lists, their order and the confidences must stay as they are: a
column gets the first role with a word that its name contains, so that
'discount' is a quantity (count) and 'customer_name' a product name (name).
"""

# All roles, then the words per role in order of priority.
ROLES = (
    "date", "revenue", "quantity", "unit_price", "cost", "profit", "product_id", "product_name",
    "category", "region", "customer_id", "customer_name", "channel", "metric", "ignore",
)

KEYWORDS = {
    "date": ("日期", "时间", "date", "time", "年", "月", "日", "timestamp", "下单时间", "创建时间", "交易时间"),
    "revenue": ("金额", "收入", "销售额", "营收", "revenue", "sales", "amount", "实收", "应收", "总价", "交易额", "流水"),
    "quantity": ("数量", "销量", "件数", "quantity", "qty", "count", "volume", "售出", "下单"),
    "unit_price": ("单价", "价格", "price", "unit_price", "定价", "售价"),
    "cost": ("成本", "cost", "进价", "采购价"),
    "profit": ("利润", "毛利", "profit", "margin", "净利"),
    "product_name": ("产品名", "商品名", "product_name", "name", "品名", "产品", "商品", "SKU"),
    "product_id": ("产品ID", "商品ID", "product_id", "sku_id", "item_id", "编号", "代码"),
    "category": ("分类", "类别", "category", "品类", "类目", "大类", "中类"),
    "region": ("区域", "地区", "region", "area", "zone", "城市", "省份", "门店", "store", "location", "大区", "华北", "华东"),
    "customer_name": ("客户", "顾客", "customer", "client", "买家", "用户"),
    "channel": ("渠道", "channel", "来源", "平台", "线上", "线下", "门店类型"),
}

HINT_CONFIDENCE = 1.0
KEYWORD_CONFIDENCE = 0.85
DATE_CONFIDENCE = 0.7
METRIC_CONFIDENCE = 0.5
NO_MATCH_CONFIDENCE = 0.3
AMBIGUOUS_BELOW = 0.6

# Roles by how their columns are cleaned.
NUMERIC_ROLES = ("revenue", "quantity", "cost", "profit", "metric")
LABEL_ROLES = ("category", "region", "channel", "product_name")
PRODUCT_ROLES = ("product_id", "product_name")
CUSTOMER_ROLES = ("customer_id", "customer_name")
