"""Names, codes and tables that decide results.

Everything here is a constant the engine must agree on with existing reports and files.
"""

# Canonical columns of the two dataset kinds, and which may be unmapped.
MOVEMENT_COLUMNS = (
    "item_code",
    "item_description",
    "warehouse",
    "movement_date",
    "movement_type",
    "quantity",
    "reference",
)
BALANCE_COLUMNS = ("item_code", "item_description", "warehouse", "balance_date", "quantity")
NULLABLE_COLUMNS = ("item_description", "warehouse", "balance_date", "reference")

# The grouping key of stock.
KEY = ("item_code", "warehouse")

# The directions every summary reports, in report order.
DIRECTIONS = ("receipt", "issue", "adjustment", "other")

# Scopes, their ledgers, and the balance that belongs to each ledger.
SCOPES = {
    "fg": ("fg_movements",),
    "rm": ("rm_movements",),
    "all": ("fg_movements", "rm_movements"),
}
BALANCE_OF = {"fg_movements": "fg_balance", "rm_movements": "rm_balance"}

# The stores of the balance reports: dataset, label, unit, ledger tag (None = no ledger).
STORES = (
    ("rm_balance", "Raw materials", "units", "rm"),
    ("fg_balance", "Finished goods", "units", "fg"),
    ("wip_balance", "Work in progress", "R", None),
)

# Export sheets and the balance dataset each one feeds.
EXPORT_SHEETS = {"RM": "rm_balance", "Product_Stock": "fg_balance", "WIP": "wip_balance"}

# Label for a blank category, and the fold label and size of the ranked categories.
UNSPECIFIED = "(unspecified)"
OTHER = "Other"
TOP_CATEGORIES = 20

# Stock-flow nodes, column of each role (left to right) and of each side hub.
PRODUCTION = "Production (DO/IC jobs)"
VENDORS = "Vendors"
CUSTOMERS = "Customers"
DIRECT_SALES = "Direct sales (RM)"
RETURNED_TO_VENDOR = "Returned to vendor"
RM_PREFIX = "RM · "
FG_PREFIX = "FG · "
ROLE_COLUMNS = {"vendors": 0, "rm_store": 1, "production": 2, "fg_store": 3, "customers": 4}
HUB_COLUMNS = {
    "Adj in (RM)": 0,
    "Adj out (RM)": 2,
    "Direct sales (RM)": 2,
    "Returned to vendor": 2,
    "Adj in (FG)": 2,
    "Adj out (FG)": 4,
}

# Movement types that stay inside a store and never become a flow.
INTERNAL_TYPES = (
    "WAREHOUSE TRANSFER IN",
    "WAREHOUSE TRANSFER OUT",
    "TRANSFERRED IN",
    "TRANSFERRED OUT",
)

# Words in a table name that suggest a dataset (kind words, subject words).
MOVEMENT_WORDS = ("movement", "movmnt", "transaction", "trans", "history")
BALANCE_WORDS = ("balance", "bal", "soh", "onhand", "on_hand", "stock")
FG_WORDS = ("finish", "product", "fg", "garment")
RM_WORDS = ("raw", "material", "rm", "fabric")
WIP_WORDS = ("wip", "progress", "work")
DATASET_WORDS = {
    "fg_movements": (MOVEMENT_WORDS, FG_WORDS),
    "rm_movements": (MOVEMENT_WORDS, RM_WORDS),
    "wip_balance": (BALANCE_WORDS, WIP_WORDS),
    "fg_balance": (BALANCE_WORDS, FG_WORDS),
    "rm_balance": (BALANCE_WORDS, RM_WORDS),
}

# Parts of a column name that suggest a canonical column, best first.
COLUMN_WORDS = {
    "item_code": (
        "itemcode", "item_code", "stockcode", "stock_code", "itemno", "item_no", "sku", "partno", "code",
    ),
    "item_description": ("itemdesc", "description", "descr", "itemname", "item_name", "desc"),
    "warehouse": ("warehouse", "whse", "store", "location", "site", "branch"),
    "movement_date": (
        "movementdate", "movement_date", "transdate", "trans_date", "txndate", "docdate", "date",
    ),
    "movement_type": (
        "movementtype", "movement_type", "transtype", "trans_type", "txntype", "doctype", "type",
    ),
    "quantity": ("quantity", "qty"),
    "reference": ("reference", "docref", "docno", "doc_no", "document", "refno", "ref"),
    "balance_date": (
        "balancedate", "balance_date", "asatdate", "as_at", "snapshotdate", "perioddate", "date",
    ),
}

# Source types accepted for a date and for a quantity; Spark's own names follow.
DATE_TYPES = ("date", "datetime", "datetime2", "smalldatetime", "datetimeoffset")
NUMERIC_TYPES = ("int", "bigint", "smallint", "decimal", "numeric", "float", "real", "money")
SPARK_DATE_TYPES = ("timestamp", "timestamp_ntz", "timestamp_ltz")
SPARK_NUMERIC_TYPES = ("byte", "tinyint", "short", "integer", "long", "double", "dec")

# Windows-1252 bytes 0x80-0x9F as Latin-1 reads them and as they are meant;
# 0x81 0x8D 0x8F 0x90 0x9D have no meaning there.
CP1252_AS_LATIN1 = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)
CP1252_MEANT = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNDEFINED = "\x81\x8d\x8f\x90\x9d"

# Characters that count as white space around a text cell.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Sentences of the narratives.
NO_MOVEMENTS = "No movements found in the selected period."
NOTHING_TO_RECONCILE = "Nothing to reconcile for the selected period."
NO_ANOMALIES = "No anomalies detected."
SUMMARY_TOTALS = (
    "Across %s items and %s warehouse(s): received %s, issued %s, "
    "adjusted %s, for a net stock change of %s units."
)
SUMMARY_MOVER = "%s %s %s units net."
RECONCILED_TOTALS = (
    "Reconciled %s item/warehouse combinations: %s balance, %s show unexplained variance."
)
RECONCILED_ROW = (
    "%s: closing balance is %s but opening %s plus recorded movements %s predicts %s — %s units "
    "%s than the movements explain. Check for unposted transactions, stocktake adjustments "
    "captured outside the movement tables, or timing cut-off."
)
ANOMALY_SENTENCES = {
    "negative_balance": (
        "%s has a NEGATIVE balance: %s. Stock was issued that the system never received — "
        "check GRN backlogs and issue timing."
    ),
    "outlier_movement": (
        "%s had an unusually large movement: %s. Verify the document capture "
        "(possible unit-of-measure or keying error)."
    ),
    "dormant_item": (
        "%s is dormant: %s. Candidate for stock count, write-off review or reallocation."
    ),
}
ANOMALY_FALLBACK = "%s: %s"
ANOMALY_REST = "...and %s more finding(s); export with --csv for the full list."
SAME_BASELINE = "opening and closing resolve to the same baseline — widen the dates"
OUTSIDE_COVERAGE = "needs baselines inside the movement window"
