"""What every input table must look like: file, grain, keys, dates and invariants.

The entries are fixed values of the input format: file names, column headers as written
in the files, and the rules the columns must obey.
"""

STOCK_PARTS = ["warehouse_stock", "store_stock", "intransit_stock"]

TABLES = {
    "store_dim": {
        "file": "store_dim.csv",
        "raw_grain": ["storeid"],
        "keys": {"store": "storeid", "city": "city", "zone": "ZONE"},
        "invariants": [
            {"name": "store_capacity_present", "type": "positive", "columns": ["PAIRS_CAPACITY"], "severity": "warn"},
        ],
    },
    "product_dim": {
        "file": "product_dim.csv",
        "raw_grain": ["dns", "item", "cname", "size"],
        "keys": {"atoms": ["dns", "item", "cname", "size"]},
    },
    "inventory_daily": {
        "file": "inventory_snapshot.csv",
        "raw_grain": ["storeid", "dns_item", "color", "size", "Date"],
        "keys": {"store": "storeid", "dns_item": ["dns_item", "color", "size"]},
        "dates": {"date": "Date"},
        "invariants": [
            {"name": "stock_components_sum_to_opening", "type": "sum_equals", "parts": STOCK_PARTS,
             "total": "opening_stk", "severity": "error"},
            {"name": "non_negative_stock", "type": "non_negative", "columns": [*STOCK_PARTS, "opening_stk"],
             "severity": "error"},
            {"name": "warehouse_stock_not_store_scoped", "type": "constant_within_group",
             "group": ["dns_item", "color", "size", "Date"], "column": "warehouse_stock", "severity": "warn"},
        ],
    },
    "sales_pos": {
        "file": "sales_pos.csv",
        "raw_grain": ["storeid", "dns_item", "color", "size", "Date"],
        "keys": {"store": "storeid", "dns_item": ["dns_item", "color", "size"]},
        "dates": {"date": "Date"},
        "invariants": [
            {"name": "non_negative_units", "type": "non_negative", "columns": ["units_sold"], "severity": "error"},
        ],
    },
    "replenishment_orders": {
        "file": "replenishment_orders.csv",
        "raw_grain": ["Store_ID", "SKU", "Size", "Order_Date"],
        "keys": {"store": "Store_ID", "branded": ["SKU", "Size"]},
        "dates": {"date": "Order_Date"},
        "invariants": [
            {"name": "warehouse_id_is_identifying", "type": "not_constant", "columns": ["Warehouse_ID"],
             "severity": "error"},
            {"name": "non_negative_replen", "type": "non_negative", "columns": ["Current_Stock", "Replenishment qty"],
             "severity": "error"},
        ],
    },
    "forecast": {
        "file": "forecast.csv",
        "raw_grain": ["options_", "size", "year", "month"],
        "keys": {"branded": ["options_", "size"], "month": ["year", "month"]},
        "invariants": [
            {"name": "non_negative_forecast", "type": "non_negative", "columns": ["prediction_size"], "severity": "error"},
        ],
    },
    "pending_orders": {
        "file": "pending_orders.csv",
        "raw_grain": ["Po_No", "dns", "Item", "cname", "size"],
        "keys": {"atoms": ["dns", "Item", "cname", "size"]},
        "dates": {"date": "Delivery Date"},
        "invariants": [
            {"name": "po_no_is_identifying", "type": "not_constant", "columns": ["Po_No"], "severity": "error"},
            {"name": "delivery_after_purchase", "type": "date_order", "earlier": "Purchase Date",
             "later": "Delivery Date", "severity": "error"},
        ],
    },
    "promotion_data": {
        "file": "promotion_data.csv",
        "raw_grain": ["city", "date"],
        "keys": {"city": "city", "zone": "zone"},
        "dates": {"date": "date"},
    },
    "vendor_data": {"file": "vendor_data.csv", "raw_grain": ["Material", "Vendor"]},
    "goods_receipts": {
        "file": "goods_receipts.csv",
        "raw_grain": ["Receipt_ID"],
        "keys": {"dns_item": ["dns_item", "color", "size"]},
        "dates": {"date": "Receipt_Date", "order_date": "Order_Date", "promised_date": "Promised_Date"},
        "invariants": [
            {"name": "receipt_after_order", "type": "date_order", "earlier": "Order_Date", "later": "Receipt_Date",
             "severity": "error"},
            {"name": "non_negative_receipt", "type": "non_negative", "columns": ["Qty_Received"], "severity": "error"},
        ],
    },
    "store_receipts": {
        "file": "store_receipts.csv",
        "raw_grain": ["Store_ID", "SKU", "Size", "Receipt_Date"],
        "keys": {"store": "Store_ID", "branded": ["SKU", "Size"]},
        "dates": {"date": "Receipt_Date", "order_date": "Order_Date"},
        "invariants": [
            {"name": "store_receipt_after_order", "type": "date_order", "earlier": "Order_Date",
             "later": "Receipt_Date", "severity": "error"},
        ],
    },
    "forecast_store_week": {
        "file": "forecast_store_week.csv",
        "raw_grain": ["storeid", "dns_item", "color", "size", "Week_Start"],
        "keys": {"store": "storeid", "dns_item": ["dns_item", "color", "size"]},
        "dates": {"date": "Week_Start"},
        "invariants": [
            {"name": "non_negative_store_forecast", "type": "non_negative",
             "columns": ["forecast_units", "actual_units"], "severity": "error"},
        ],
    },
    "external_signals_fact": {
        "file": "external_signals_fact.csv",
        "raw_grain": ["Brand", "City", "Footwear_Type", "post_datetime"],
        "keys": {"city": "City", "brand": "Brand"},
        "dates": {"date": "post_datetime"},
        "invariants": [
            {"name": "engagement_rate_consistent", "type": "ratio_equals",
             "numerator": ["post_like_count", "post_comment_count", "post_share_count"], "denominator": "reach",
             "scale": 100, "result": "engagement_rate_pct", "tolerance": 0.05, "severity": "warn"},
        ],
    },
}

REFERENTIAL = [
    {"name": "inventory_store_in_store_dim", "child": "inventory_daily", "parent": "store_dim", "key": "store_id"},
    {"name": "replenishment_store_in_store_dim", "child": "replenishment_orders", "parent": "store_dim", "key": "store_id"},
    {"name": "sales_store_in_store_dim", "child": "sales_pos", "parent": "store_dim", "key": "store_id"},
    {"name": "inventory_sku_in_product_dim", "child": "inventory_daily", "parent": "product_dim", "key": "sku_uid"},
    {"name": "replenishment_sku_in_product_dim", "child": "replenishment_orders", "parent": "product_dim", "key": "sku_uid"},
    {"name": "sales_sku_in_product_dim", "child": "sales_pos", "parent": "product_dim", "key": "sku_uid"},
    {"name": "forecast_option_in_product_dim", "child": "forecast", "parent": "product_dim", "key": "option_uid"},
    {"name": "promotion_city_in_store_dim", "child": "promotion_data", "parent": "store_dim", "key": "city_norm",
     "severity": "warn"},
]

SURVIVAL_TABLES = ["inventory_daily", "sales_pos", "replenishment_orders"]
