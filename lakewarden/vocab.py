"""Vocabularies: everything that is data rather than logic.

Every list below is a set of FIXED VALUES. They decide the results (which
pattern means which category, which role outranks which), so they are stated
plainly and in evaluation order; the operators take them as default arguments
and accept others.
"""

from __future__ import annotations

from typing import NamedTuple

# --------------------------------------------------------------------------
# Ordered scales
# --------------------------------------------------------------------------
# Sensitivity levels, lowest first.
SENSITIVITY = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")
# Role names, least privileged first.
ROLES = ("viewer", "data_analyst", "data_steward", "admin")
# Fixed values: (grade, lowest overall score that earns it), best first.
GRADES = (("A", 0.9), ("B", 0.75), ("C", 0.6), ("D", 0.4), ("F", 0.0))
# Weight of each quality part in the overall score.
QUALITY_WEIGHTS = {"completeness": 0.35, "uniqueness": 0.25, "validity": 0.25, "consistency": 0.15}


# --------------------------------------------------------------------------
# Classification rules
# --------------------------------------------------------------------------
class Rule(NamedTuple):
    name_re: str
    value_re: str | None
    category: str
    level: str


# Service rules, in the order that breaks ties.
SERVICE_RULES = (
    Rule(r"(^|_)(ssn|social_sec|social_security)($|_)", r"^\d{3}-?\d{2}-?\d{4}$", "SSN", "RESTRICTED"),
    Rule(r"(^|_)(passport|passport_num)($|_)", None, "PASSPORT", "RESTRICTED"),
    Rule(r"(^|_)(drivers?_lic|dl_num)($|_)", None, "DRIVERS_LICENSE", "RESTRICTED"),
    Rule(r"(^|_)(national_id|natl_id|nid)($|_)", None, "NATIONAL_ID", "RESTRICTED"),
    Rule(r"(^|_)(tax_id|tin|ein|itin)($|_)", r"^\d{2}-?\d{7}$", "TAX_ID", "RESTRICTED"),
    Rule(r"(^|_)(credit_card|cc_num|card_number|pan)($|_)", r"^\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}$", "CREDIT_CARD", "RESTRICTED"),
    Rule(r"(^|_)(bank_account|acct_num|account_number)($|_)", None, "BANK_ACCOUNT", "RESTRICTED"),
    Rule(r"(^|_)(salary|wage|compensation|annual_pay)($|_)", None, "SALARY", "CONFIDENTIAL"),
    Rule(r"(^|_)(financial|billing|invoice_amt)($|_)", None, "FINANCIAL_DATA", "CONFIDENTIAL"),
    Rule(r"(^|_)(email|email_addr|mail)($|_)", r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$", "EMAIL", "CONFIDENTIAL"),
    Rule(r"(^|_)(phone|mobile|cell|telephone|fax)($|_)", r"^[\+\d\s\(\)\-]{7,20}$", "PHONE", "CONFIDENTIAL"),
    Rule(r"(^|_)(full_name|fullname|customer_name)($|_)", None, "FULL_NAME", "CONFIDENTIAL"),
    Rule(r"(^|_)(first_name|fname|given_name)($|_)", None, "FIRST_NAME", "CONFIDENTIAL"),
    Rule(r"(^|_)(last_name|lname|surname|family_name)($|_)", None, "LAST_NAME", "CONFIDENTIAL"),
    Rule(r"(^|_)(dob|date_of_birth|birthdate|birth_date)($|_)", r"^\d{4}[-/]\d{2}[-/]\d{2}$", "DATE_OF_BIRTH", "CONFIDENTIAL"),
    Rule(r"(^|_)(age|years_old|birth_year)($|_)", None, "AGE", "INTERNAL"),
    Rule(r"(^|_)(gender|sex|gender_code)($|_)", None, "GENDER", "CONFIDENTIAL"),
    Rule(r"(^|_)(race|ethnicity|ethnic_group)($|_)", None, "RACE_ETHNICITY", "RESTRICTED"),
    Rule(r"(^|_)(address|street|addr)($|_)", None, "ADDRESS", "CONFIDENTIAL"),
    Rule(r"(^|_)(zip|zip_code|postal|postcode)($|_)", r"^\d{5}(-\d{4})?$", "ZIP_CODE", "INTERNAL"),
    Rule(r"(^|_)(city|town)($|_)", None, "CITY", "INTERNAL"),
    Rule(r"(^|_)(latitude|longitude|lat|lon|geo_loc)($|_)", None, "LOCATION", "CONFIDENTIAL"),
    Rule(r"(^|_)(ip_addr|ip_address|ipv4|ipv6)($|_)", r"^(\d{1,3}\.){3}\d{1,3}$", "IP_ADDRESS", "CONFIDENTIAL"),
    Rule(r"(^|_)(patient|medical_rec|health|mrn)($|_)", None, "HEALTH_RECORD", "RESTRICTED"),
    Rule(r"(^|_)(diagnosis|icd|disease|condition)($|_)", None, "DIAGNOSIS", "RESTRICTED"),
    Rule(r"(^|_)(medication|drug|prescription|rx)($|_)", None, "MEDICATION", "RESTRICTED"),
    Rule(r"(^|_)(biometric|fingerprint|facial|iris_scan)($|_)", None, "BIOMETRIC", "RESTRICTED"),
    Rule(r"(^|_)(genetic|dna|genome)($|_)", None, "GENETIC_DATA", "RESTRICTED"),
    Rule(r"(^|_)(password|passwd|pwd|passphrase)($|_)", None, "PASSWORD", "RESTRICTED"),
    Rule(r"(^|_)(api_key|token|secret|access_key|auth_token)($|_)", None, "AUTH_TOKEN", "RESTRICTED"),
    Rule(r"(^|_)(username|user_name|login_id)($|_)", None, "USERNAME", "INTERNAL"),
)

# Words that mark a column SENSITIVE / INTERNAL when no rule fires.
FALLBACK_WORDS = ("secret", "private", "internal", "confidential", "restricted")

# Offline-profile rules; both patterns are case-insensitive searches.
SIM_RULES = (
    Rule(r"ssn|social.?sec|social_security", r"\d{3}-\d{2}-\d{4}", "PERSONAL", "RESTRICTED"),
    Rule(r"passport", r"[A-Z]{1,2}\d{6,9}", "PERSONAL", "RESTRICTED"),
    Rule(r"credit.?card|card.?number|card_num", r"\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}", "FINANCIAL", "RESTRICTED"),
    Rule(r"password|passwd|pwd|secret", r".", "CREDENTIALS", "RESTRICTED"),
    Rule(r"biometric|fingerprint|iris_scan", r".", "PERSONAL", "RESTRICTED"),
    Rule(r"genetic|dna_seq", r".", "HEALTH", "RESTRICTED"),
    Rule(r"medical_record|diagnosis|icd_code", r".", "HEALTH", "RESTRICTED"),
    Rule(r"token|auth_token|api_key|secret_key", r"[A-Za-z0-9_\-]{20,}", "CREDENTIALS", "RESTRICTED"),
    Rule(r"(^|_)dob$|date.of.birth|birth.?date", r"\d{4}-\d{2}-\d{2}", "PERSONAL", "CONFIDENTIAL"),
    Rule(r"salary|compensation|pay.?rate|wage", r"[\d\.,]+", "PERSONAL", "CONFIDENTIAL"),
    Rule(r"ip.?addr|ip_address|remote_addr", r"\d{1,3}\.\d{1,3}\.\d{1,3}", "PERSONAL", "CONFIDENTIAL"),
    Rule(r"account.?balance|closing_balance|opening_balance", r"[\d\.,]+", "FINANCIAL", "CONFIDENTIAL"),
    Rule(r"fraud.?score|risk.?score", r"[\d\.]+", "FINANCIAL", "CONFIDENTIAL"),
    Rule(r"(^|_)(first|last|full|middle).?name$|employee_name|person_name", r"[A-Za-z\s\-']{2,}", "PERSONAL", "INTERNAL"),
    Rule(r"email|e.?mail|mail.?addr", r"[^@\s]+@[^@\s]+\.[^@\s]+", "PERSONAL", "INTERNAL"),
    Rule(r"phone|mobile|cell|tel", r"[\d\s\-\+\(\)]{7,}", "PERSONAL", "INTERNAL"),
    Rule(r"address|addr|street|city|state|zip|postal", r".", "PERSONAL", "INTERNAL"),
)

# Heuristic name patterns used when no classifier is reachable, first match wins.
HEURISTIC_PII = (
    (r"(^|_)(ssn|social.*sec|sin|tin|ein)($|_)", "SSN"),
    (r"(^|_)(email|e_mail|mail_addr)($|_)", "EMAIL"),
    (r"(^|_)(phone|mobile|cell|fax|tel)($|_)", "PHONE"),
    (r"(^|_)(first.*name|last.*name|full.*name|fname|lname)($|_)", "NAME"),
    (r"(^|_)(dob|birth.*date|date.*birth|birthdate)($|_)", "DATE_OF_BIRTH"),
    (r"(^|_)(addr|address|street|zip|postal)($|_)", "ADDRESS"),
    (r"(^|_)(ip_addr|ip_address|ipaddr)($|_)", "IP_ADDRESS"),
    (r"(^|_)(passport|license|drivers.*lic)($|_)", "GOVERNMENT_ID"),
    (r"(^|_)(credit.*card|cc_num|card_num)($|_)", "PAYMENT_CARD"),
    (r"(^|_)(patient|medical.*rec|health)($|_)", "HEALTH_DATA"),
)
# Words that mark a column SENSITIVE in the heuristic.
HEURISTIC_SENSITIVE = ("salary", "wage", "income", "bonus", "tax", "password", "secret", "token")

# Default level of a category.
CATEGORY_LEVEL = {
    "PASSWORD": "RESTRICTED", "AUTH_TOKEN": "RESTRICTED", "CREDIT_CARD": "RESTRICTED",
    "SSN": "RESTRICTED", "PASSPORT": "RESTRICTED", "HEALTH_RECORD": "RESTRICTED",
    "GENETIC_DATA": "RESTRICTED", "RACE_ETHNICITY": "RESTRICTED", "EMAIL": "CONFIDENTIAL",
    "PHONE": "CONFIDENTIAL", "SALARY": "CONFIDENTIAL", "DATE_OF_BIRTH": "CONFIDENTIAL",
}

# The 38 category names.
CATEGORIES = (
    "SSN", "NATIONAL_ID", "PASSPORT", "DRIVERS_LICENSE", "CREDIT_CARD", "BANK_ACCOUNT", "EMAIL",
    "PHONE", "FULL_NAME", "FIRST_NAME", "LAST_NAME", "DATE_OF_BIRTH", "AGE", "ADDRESS", "CITY",
    "STATE", "ZIP_CODE", "COUNTRY", "IP_ADDRESS", "MAC_ADDRESS", "LOCATION", "HEALTH_RECORD",
    "DIAGNOSIS", "MEDICATION", "BIOMETRIC", "GENDER", "RACE_ETHNICITY", "RELIGION",
    "SEXUAL_ORIENTATION", "SALARY", "FINANCIAL_DATA", "TAX_ID", "USERNAME", "PASSWORD",
    "AUTH_TOKEN", "DEVICE_ID", "COOKIE", "GENETIC_DATA",
)

# The value patterns above without anchors, for scanning whole texts.
VALUE_SCAN = (
    ("SSN", r"\d{3}-?\d{2}-?\d{4}"),
    ("TAX_ID", r"\d{2}-?\d{7}"),
    ("CREDIT_CARD", r"\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}"),
    ("EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("PHONE", r"[\+\d\s\(\)\-]{7,20}"),
    ("DATE_OF_BIRTH", r"\d{4}[-/]\d{2}[-/]\d{2}"),
    ("ZIP_CODE", r"\d{5}(-\d{4})?"),
    ("IP_ADDRESS", r"(\d{1,3}\.){3}\d{1,3}"),
)

# --------------------------------------------------------------------------
# Domains, descriptions, table-name terms
# --------------------------------------------------------------------------
# Description texts that count as missing.
BLANK_DESCRIPTIONS = ("n/a", "na", "none", "null", "tbd", "todo", "unknown", "")

# Domain patterns, ties go to the earlier domain.
DOMAIN_PATTERNS = {
    "finance": ("amount", "price", "cost", "revenue", "profit", "tax", "account.*num"),
    "hr": ("employee", "staff", "salary", "payroll", "dept.*id", "hire.*date"),
    "customer": ("customer", "client", "member", "subscriber", "prospect"),
    "product": ("product", "item", "sku", "catalog", "inventory"),
    "operations": ("order", "shipment", "delivery", "warehouse", "logistics"),
    "security": ("audit", "log", "access", "permission", "role", "session"),
}

# Domain keywords of the offline profile, ties go to the earlier domain.
SIM_DOMAIN_WORDS = {
    "finance": ("payment", "transaction", "account", "balance", "credit", "debit", "currency", "amount", "invoice", "revenue", "financial", "interest", "salary"),
    "hr": ("employee", "hire", "department", "salary", "payroll", "manager", "staff", "workforce", "job", "position", "termination", "employment"),
    "customer": ("customer", "client", "user", "member", "subscriber", "consumer", "address", "email", "phone", "contact"),
    "product": ("product", "catalog", "sku", "item", "inventory", "stock", "price", "supplier", "category", "review", "rating"),
    "compliance": ("audit", "fraud", "risk", "compliance", "control", "regulation", "policy", "breach", "incident", "violation"),
    "operations": ("system", "status", "flag", "active", "created", "updated", "deleted", "modified", "timestamp", "log"),
}

# Table-name token -> terms.
TABLE_TERMS = {
    "customer": ("Customer", "Party", "Consumer"),
    "order": ("Order", "Transaction", "Sales Order"),
    "product": ("Product", "Item", "SKU", "Asset"),
    "employee": ("Employee", "Staff", "Personnel", "Worker"),
    "account": ("Account", "Ledger Entry", "Financial Account"),
    "invoice": ("Invoice", "Bill", "Accounts Receivable"),
}


# --------------------------------------------------------------------------
# Glossaries
# --------------------------------------------------------------------------
class Term(NamedTuple):
    name: str
    definition: str
    domain: str
    synonyms: tuple[str, ...]
    abbreviations: tuple[str, ...]


# Seed glossary, in insertion order.
SEED_TERMS = (
    Term("Customer", "An individual or organization that purchases or uses company products/services.", "customer", ("Client", "Consumer", "Buyer", "Account"), ("CUST",)),
    Term("Product SKU", "Stock Keeping Unit — unique identifier for a product variant.", "product", ("Item Code", "Product Code", "Part Number"), ("SKU",)),
    Term("Fiscal Year", "The 12-month accounting period used for financial reporting.", "finance", ("Financial Year", "Tax Year"), ("FY",)),
    Term("Revenue", "Total income generated from sales of goods or services before deductions.", "finance", ("Gross Revenue", "Top Line", "Turnover"), ()),
    Term("Net Income", "Profit remaining after all expenses, taxes, and costs are deducted.", "finance", ("Net Profit", "Bottom Line", "Net Earnings"), ()),
    Term("Employee ID", "Unique identifier assigned to each employee in the HR system.", "hr", ("Staff ID", "Worker ID", "Personnel Number"), ("EMP_ID", "EID")),
    Term("Order ID", "Unique identifier for a sales or purchase order.", "operations", ("Order Number", "PO Number"), ("ORD_ID",)),
    Term("Transaction Date", "The date on which a financial transaction occurred.", "finance", ("Transaction Timestamp", "Event Date", "Posting Date"), ()),
    Term("Cost Center", "Organizational unit that incurs costs and is responsible for budget control.", "finance", ("Budget Center", "Cost Unit"), ("CC", "COST_CTR")),
    Term("PII", "Personally Identifiable Information — data that could identify a specific individual.", "security", ("Personal Data", "Personal Information"), ("PII",)),
    Term("SLA", "Service Level Agreement — commitment defining expected service standards and response times.", "operations", ("Service Agreement",), ("SLA",)),
    Term("KYC", "Know Your Customer — process of verifying the identity of clients.", "compliance", ("Customer Verification", "Customer Due Diligence"), ("KYC", "CDD")),
    Term("GDPR", "General Data Protection Regulation — EU law on data protection and privacy.", "compliance", ("Data Protection Regulation",), ("GDPR",)),
    Term("Data Lineage", "The history and lifecycle of data showing its origins, movements, and transformations.", "data_governance", ("Data Provenance", "Data History"), ()),
    Term("Master Data", "Core business data that is shared and reused across the enterprise.", "data_governance", ("Reference Data", "Golden Record"), ()),
)

# Glossary of the offline profile (name, synonyms), in order.
SIM_TERMS = (
    ("Customer ID", ("client_id", "cust_id", "customer_number")),
    ("Account Balance", ("balance", "closing_balance", "net_balance")),
    ("Transaction Amount", ("amount", "txn_amount", "payment_amount")),
    ("Employee ID", ("emp_id", "staff_id", "worker_id")),
    ("Annual Salary", ("salary", "compensation", "yearly_pay", "base_salary")),
    ("Product SKU", ("sku", "product_code", "item_code", "part_number")),
    ("Email Address", ("email", "mail", "email_addr", "contact_email")),
    ("Fraud Score", ("risk_score", "fraud_probability", "anomaly_score")),
    ("Date of Birth", ("dob", "birth_date", "birthdate", "date_of_birth")),
    ("Department Code", ("dept_code", "department", "org_unit")),
    ("Currency Code", ("currency", "iso_currency", "fx_code")),
    ("Product Category", ("category", "product_type", "item_class", "category_name")),
    ("Unit Price", ("price", "list_price", "retail_price", "unit_cost")),
    ("Customer Segment", ("segment", "tier", "customer_tier", "client_category")),
)

# --------------------------------------------------------------------------
# Source types
# --------------------------------------------------------------------------
# Declared source types and those that can be read.
SOURCE_TYPES = ("teradata", "mssql", "bigquery", "postgresql", "mysql", "snowflake", "oracle", "sqlite")
READABLE_SOURCES = ("teradata", "mssql", "bigquery", "sqlite", "postgresql")

# Native type -> canonical type per source.
TYPE_MAPS = {
    "teradata": {
        "CV": "VARCHAR", "CF": "CHAR", "I": "INTEGER", "I1": "BYTEINT", "I2": "SMALLINT", "I8": "BIGINT",
        "F": "FLOAT", "D": "DECIMAL", "DA": "DATE", "TS": "TIMESTAMP", "TZ": "TIMESTAMP WITH TIME ZONE",
        "AT": "TIME", "BF": "BYTE", "BV": "VARBYTE", "BO": "BLOB", "CO": "CLOB", "N": "NUMBER",
        "++": "PERIOD", "YR": "INTERVAL YEAR",
    },
    "mssql": {
        "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT", "bit": "BOOLEAN",
        "decimal": "DECIMAL", "numeric": "NUMERIC", "money": "MONEY", "smallmoney": "MONEY", "float": "FLOAT",
        "real": "REAL", "datetime": "DATETIME", "datetime2": "DATETIME2", "smalldatetime": "DATETIME",
        "date": "DATE", "time": "TIME", "datetimeoffset": "TIMESTAMP WITH TIME ZONE", "char": "CHAR",
        "varchar": "VARCHAR", "text": "TEXT", "nchar": "NCHAR", "nvarchar": "NVARCHAR", "ntext": "NTEXT",
        "binary": "BINARY", "varbinary": "VARBINARY", "image": "IMAGE", "uniqueidentifier": "UUID",
        "xml": "XML", "json": "JSON", "geography": "GEOGRAPHY", "geometry": "GEOMETRY",
        "hierarchyid": "HIERARCHYID", "timestamp": "ROWVERSION", "rowversion": "ROWVERSION",
        "sql_variant": "SQL_VARIANT",
    },
    "postgresql": {
        "int2": "SMALLINT", "int4": "INTEGER", "int8": "BIGINT", "float4": "FLOAT", "float8": "DOUBLE",
        "numeric": "DECIMAL", "money": "DECIMAL", "bool": "BOOLEAN", "bpchar": "CHAR", "varchar": "VARCHAR",
        "text": "TEXT", "date": "DATE", "timestamp": "TIMESTAMP", "timestamptz": "TIMESTAMP_TZ",
        "time": "TIME", "timetz": "TIME_TZ", "json": "JSON", "jsonb": "JSON", "uuid": "UUID",
        "bytea": "BINARY", "inet": "INET", "cidr": "CIDR", "macaddr": "MACADDR", "xml": "XML",
        "array": "ARRAY", "tsvector": "TSVECTOR",
    },
    "bigquery": {
        "STRING": "VARCHAR", "BYTES": "VARBYTE", "INTEGER": "BIGINT", "INT64": "BIGINT", "FLOAT": "FLOAT",
        "FLOAT64": "FLOAT", "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "TIMESTAMP": "TIMESTAMP",
        "DATE": "DATE", "TIME": "TIME", "DATETIME": "DATETIME", "NUMERIC": "NUMERIC",
        "BIGNUMERIC": "BIGNUMERIC", "RECORD": "STRUCT", "STRUCT": "STRUCT", "ARRAY": "ARRAY",
        "JSON": "JSON", "GEOGRAPHY": "GEOGRAPHY",
    },
    "sqlite": {
        "INTEGER": "INTEGER", "INT": "INTEGER", "REAL": "FLOAT", "TEXT": "VARCHAR", "BLOB": "BINARY",
        "NUMERIC": "DECIMAL", "BOOLEAN": "BOOLEAN", "DATE": "DATE", "DATETIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
    },
}
# Substring -> affinity, first hit wins; DATE/TIME keep their own name; else NUMERIC.
AFFINITY = (
    (("INT",), "INTEGER"),
    (("CHAR", "CLOB", "TEXT"), "TEXT"),
    (("REAL", "FLOA", "DOUB"), "REAL"),
    (("BLOB",), "BLOB"),
)
# File-name prefix -> virtual schema, first match wins.
PREFIX_SCHEMAS = (("finance_", "FINANCE_DB"), ("hr_", "HR_DB"), ("product_", "PRODUCT_DB"))
# Schemas never profiled.
SYSTEM_SCHEMAS = {
    "postgresql": ("information_schema", "pg_catalog", "pg_toast", "pg_temp_1", "pg_toast_temp_1"),
    "teradata": (),
    "mssql": (
        "sys", "INFORMATION_SCHEMA", "guest", "db_owner", "db_accessadmin", "db_securityadmin",
        "db_ddladmin", "db_backupoperator", "db_datareader", "db_datawriter", "db_denydatareader",
        "db_denydatawriter",
    ),
    "bigquery": (),
    "sqlite": (),
}
# Fixed values: (row threshold above which a profile is sampled, percent); None = always.
SAMPLING = {
    "teradata": (None, 10.0),
    "mssql": (10_000, 10.0),
    "postgresql": (10_000, 5.0),
    "bigquery": (100_000, 5.0),
    "sqlite": (2**62, 100.0),
}

# --------------------------------------------------------------------------
# Audit
# --------------------------------------------------------------------------
# Accepted audit event types and outcomes.
AUDIT_EVENT_TYPES = (
    "LOGIN", "LOGOUT", "LOGIN_FAILED", "TOKEN_REFRESHED", "ASSET_READ", "ASSET_WRITE", "ASSET_DELETE",
    "COLUMN_READ", "PII_ACCESS", "TERM_CREATED", "TERM_UPDATED", "TERM_ASSIGNED", "SOURCE_REGISTERED",
    "HYDRATION_STARTED", "HYDRATION_COMPLETED", "CLASSIFICATION_OVERRIDE", "LINEAGE_CREATED",
    "USER_CREATED", "USER_UPDATED", "USER_ROLE_CHANGED", "USER_DELETED", "ACCESS_DENIED",
    "POLICY_VIOLATION",
)
AUDIT_OUTCOMES = ("SUCCESS", "FAILURE", "DENIED")

# --------------------------------------------------------------------------
# Access policy: resource -> action -> lowest role that may
# --------------------------------------------------------------------------
# Local role matrix.
RBAC_MATRIX = {
    "asset": {"read": "viewer", "read_sensitive": "data_analyst", "read_pii": "data_steward", "write": "data_steward", "delete": "admin"},
    "column": {"read": "viewer", "read_pii_value": "admin", "write": "data_steward"},
    "term": {"read": "viewer", "write": "data_steward", "delete": "data_steward"},
    "source": {"read": "data_steward", "write": "admin", "delete": "admin"},
    "user": {"read": "admin", "write": "admin"},
    "audit": {"read": "admin"},
    "lineage": {"read": "data_analyst", "write": "data_steward"},
}
# Matrix of the central policy.
OPA_MATRIX = {
    "asset": {"read": "viewer", "read_sensitive": "data_analyst", "read_pii": "data_steward", "write": "data_steward", "delete": "admin"},
    "column": {"read": "viewer", "read_pii_value": "admin", "write": "data_steward", "delete": "data_steward"},
    "term": {"read": "viewer", "write": "data_steward", "delete": "data_steward"},
    "source": {"read": "data_steward", "write": "admin", "delete": "admin", "hydrate": "admin"},
    "user": {"read": "admin", "write": "admin", "delete": "admin"},
    "audit": {"read": "admin"},
    "lineage": {"read": "data_analyst", "write": "data_steward"},
    "classification": {"read": "data_analyst", "override": "data_steward"},
}

# --------------------------------------------------------------------------
# Histogram buckets of the hydration duration metric (seconds)
# --------------------------------------------------------------------------
# Upper bucket bounds.
DURATION_BUCKETS = (1, 5, 15, 30, 60, 120, 300, 600)
# Retention in days.
RETENTION_DAYS = {"assets": 3650, "audit_log": 2555}
