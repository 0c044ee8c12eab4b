"""Vocabulary of the column matcher and the cleaners, kept as plain data.

Everything in this file is a fixed value: results only agree if the words, their order and the
numbers are exactly these. Sizes are known when the package is imported (about 200 aliases), so the
small tables made from them may be broadcast.
"""

from __future__ import annotations

# Target field, label, group, aliases (order decides ties).
FIELDS: list[tuple[str, str, str, list[str]]] = [
    ("customer_id", "Customer ID", "Customer", [
        "customerid", "customer_id", "client_id", "buyer_id",
        "customer_no", "member_id", "account_id", "loyalty_id",
        "cust_id", "cx_id", "user_id",
        "معرف_العميل", "كود_العميل", "رقم_العميل",
    ]),
    ("customer.fullName", "Customer name", "Customer", [
        "customername", "customer_name", "full_name", "fullname",
        "name", "client_name", "buyer_name", "recipient_name",
        "firstname", "first_name", "lastname", "last_name",
        "اسم_العميل", "الاسم", "اسم",
    ]),
    ("customer.email", "Email address", "Customer", [
        "email", "email_address", "emailaddress", "e_mail",
        "mail", "customer_email", "client_email",
        "البريد_الالكتروني", "ايميل",
    ]),
    ("customer.phoneNumber", "Phone number", "Customer", [
        "phone", "phonenumber", "phone_number", "mobile",
        "mobile_number", "cell", "telephone", "tel",
        "contact_number", "mob",
        "رقم_الهاتف", "موبايل", "تليفون",
    ]),
    ("customer.segment", "Customer segment / type", "Customer", [
        "segment", "customer_segment", "customer_type",
        "tier", "customer_tier", "loyalty_tier", "membership",
        "شريحة_العميل", "نوع_العميل",
    ]),
    ("product_id", "Product SKU / code", "Product", [
        "stockcode", "stock_code", "sku", "sku_code", "skucode", "product_id", "item_id",
        "product_code", "item_code", "article_id", "part_no",
        "barcode", "upc", "ean", "model_no", "style_id",
        "معرف_المنتج", "كود_المنتج", "رقم_المنتج",
    ]),
    ("product.name", "Product name", "Product", [
        "description", "product_name", "productname", "item_name",
        "product", "item", "article", "good", "merchandise",
        "product_title", "item_title",
        "اسم_المنتج", "المنتج", "صنف", "وصف_المنتج",
    ]),
    ("product.price", "Selling price", "Product", [
        "unitprice", "unit_price", "price", "selling_price", "sale_price",
        "retail_price", "list_price", "base_price", "price_per_unit",
        "item_price", "product_price", "prices_list",
        "سعر", "السعر", "سعر_البيع", "سعر_الوحدة",
    ]),
    ("product.cost", "Cost price", "Product", [
        "cost", "unit_cost", "unit_cost_egp", "cost_egp", "cogs", "purchase_price", "cost_price",
        "cost_of_goods", "buying_price", "supplier_price",
        "wholesale_price", "avg_cost", "calculated_cost",
        "تكلفة", "التكلفة", "سعر_التكلفة",
    ]),
    ("product.stock", "Stock / inventory", "Product", [
        "stock", "inventory", "stock_level", "on_hand",
        "available_qty", "stock_quantity", "current_stock",
        "units_in_stock", "units_available",
        "مخزون", "المخزون",
    ]),
    ("product.description", "Product description", "Product", [
        "product_description", "item_description",
        "details", "product_details", "product_notes",
        "وصف", "وصف_المنتج",
    ]),
    ("order_id", "Order / invoice number", "Order", [
        "invoiceno", "invoiceno", "invoice_no", "invoice_number", "order_id",
        "order_no", "order_number", "transaction_id", "sale_id",
        "receipt_id", "receipt_no", "confirmation_id",
        "reference_id", "purchase_order_id", "po_number",
        "رقم_الطلب", "معرف_الطلب", "رقم_الفاتورة",
    ]),
    ("order_date", "Order date", "Order", [
        "invoicedate", "invoice_date", "order_date", "date",
        "transaction_date", "purchase_date", "sale_date",
        "order_time", "order_datetime", "created_at",
        "تاريخ_الطلب", "تاريخ", "تاريخ_البيع",
    ]),
    ("order_item.quantity", "Quantity sold", "Order", [
        "quantity", "qty", "units", "amount", "count",
        "num_items", "number_of_units", "ordered_qty",
        "sold_qty", "units_sold", "pieces", "pcs",
        "كمية", "الكمية", "عدد", "وحدات",
    ]),
    ("order.status", "Order status", "Order", [
        "status", "order_status", "orderstatus",
        "fulfillment_status", "delivery_status", "payment_status",
        "state", "order_state",
        "حالة_الطلب", "حالة",
    ]),
    ("order.address", "Delivery address", "Order", [
        "address", "shipping_address", "delivery_address",
        "ship_to", "deliver_to", "full_address",
        "عنوان", "عنوان_الشحن",
    ]),
    ("revenue", "Total revenue / sales amount", "Order", [
        "revenue", "total", "total_amount", "totalprice",
        "sales", "total_sales", "grand_total", "subtotal",
        "order_total", "invoice_total", "payment_amount",
        "إيرادات", "المبيعات", "مبيعات",
    ]),
    ("profit", "Profit", "Order", [
        "profit", "net_profit", "gross_profit", "earnings",
        "net_income", "net_gain",
        "ربح", "الربح", "صافي_الربح",
    ]),
    ("profit_margin", "Profit margin %", "Order", [
        "profit_margin", "gross_margin", "net_margin",
        "margin", "margin_pct", "margin_percent",
        "هامش_الربح", "هامش_ربح",
    ]),
]

# Attribute key, label, aliases.
ATTRIBUTES: list[tuple[str, str, list[str]]] = [
    ("size", "Size", [
        "size", "sizes", "size_code", "clothing_size", "apparel_size", "fit", "size_fit",
        "مقاس", "المقاس", "قياس"]),
    ("color", "Colour", [
        "color", "colour", "colors", "shade", "colour_shade", "color_shade", "item_color",
        "لون", "اللون"]),
    ("gender", "Gender / audience", [
        "gender", "target_gender", "mens", "womens", "unisex", "جنس", "رجالي", "حريمي"]),
    ("season", "Season", [
        "season", "seasons", "seasonal", "collection_season", "موسم", "الموسم"]),
    ("collection", "Collection / line", [
        "collection", "line", "product_line", "series", "range", "مجموعة", "الكولكشن"]),
]

# Names that never match a target.
DENYLIST = ["country", "city", "region", "state", "province", "continent", "area", "zone",
            "locale", "location", "nationality", "currency"]

# Friendly labels for columns that stay unmapped.
METADATA_LABELS = {
    "invoiceno": "Invoice number (duplicate of order ID)",
    "invoice_no": "Invoice number (duplicate of order ID)",
    "payment_method": "Payment method", "pay_method": "Payment method",
    "payment": "Payment method", "payment_type": "Payment method",
    "order_source": "Sales channel", "channel": "Sales channel", "source": "Sales channel",
    "sales_rep": "Sales representative", "rep": "Sales representative",
    "agent": "Sales representative",
    "return_reason": "Return / refund reason", "refund_reason": "Return / refund reason",
    "promo_disc": "Promotional discount",
    "voucher_code": "Voucher / coupon code", "coupon": "Voucher / coupon code",
    "promo_code": "Voucher / coupon code",
    "category": "Product category", "category_name": "Product category",
    "sub_category": "Product sub-category", "type": "Product type",
    "comments": "Order notes", "remarks": "Order notes", "notes": "Order notes",
    "city": "City / area", "city_area": "City / area", "region": "Region",
}

# Arabic letter -> Latin letters; the short vowels and the hamza vanish.
TRANSLITERATION = {
    "ا": "a", "أ": "a", "إ": "i", "آ": "aa", "ب": "b", "ت": "t",
    "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh",
    "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d",
    "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "q",
    "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w",
    "ي": "y", "ى": "a", "ة": "a", "ء": "", "ئ": "y", "ؤ": "w",
    "ً": "", "ٌ": "", "ٍ": "", "َ": "",
    "ُ": "", "ِ": "", "ّ": "", "ْ": "", " ": "_",
}

# Order-status words and the status each one stands for.
STATUS_WORDS = {
    "shipped": "shipped", "delivered": "shipped", "dispatched": "shipped",
    "completed": "completed", "done": "completed", "finished": "completed",
    "pending": "pending", "processing": "pending", "new": "pending",
    "open": "pending", "confirmed": "pending",
    "cancelled": "cancelled", "canceled": "cancelled", "refunded": "cancelled",
    "returned": "cancelled", "failed": "cancelled", "rejected": "cancelled",
}
DEFAULT_STATUS = "completed"

# Words whose share marks a status column.
STATUS_VOCABULARY = ["shipped", "delivered", "pending", "cancelled", "canceled", "completed",
                     "processing", "returned", "refunded", "failed"]

# Cell texts a CSV reader takes for a missing value.
MISSING_CELLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# The required analytics fields and the mapped target that supplies each.
REQUIRED_FIELDS = {
    "quantity": "order_item.quantity",
    "price": "product.price",
    "cost": "product.cost",
    "stock": "product.stock",
    "revenue": "revenue",
    "profit": "profit",
    "profit_margin": "profit_margin",
    "order_date": "order_date",
    "product_id": "product_id",
    "customer_id": "customer_id",
}

# Field, formula text, fields it needs; in the order they are tried.
DERIVATIONS: list[tuple[str, str, tuple[str, str]]] = [
    ("revenue", "price × quantity", ("price", "quantity")),
    ("profit", "revenue − cost", ("revenue", "cost")),
    ("profit_margin", "profit ÷ revenue × 100", ("profit", "revenue")),
    ("cost", "revenue − profit", ("revenue", "profit")),
]

UNMAPPED = "__unmapped__"
ATTRIBUTE_PREFIX = "__attributes__."

# Thresholds of the segmentation and refresh rules.
MIN_PRODUCTS = 15
NEW_ITEMS_THRESHOLD = 50
PRODUCT_CHANGES_THRESHOLD = 5
REFRESH_AFTER_DAYS = 7
MAX_CLUSTERS = 10
RESTARTS = 10
SEED = 42

# The columns of the flat training table, in order.
TRAINING_COLUMNS = ["order_id", "price", "cost", "quantity", "stock", "profit_margin", "revenue",
                    "customer_id", "order_date"]
