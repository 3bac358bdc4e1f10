"""Example column metadata: 68 columns of six business tables.

Fixed values. They give the derived catalog realistic column names, types and
samples, and are the input of the golden tests.
"""

# table -> (schema, rows, bytes)
TABLES = {
    "CUSTOMER_MASTER": ("FINANCE_DB", 4823901, 1843200000),
    "PAYMENT_TRANSACTIONS": ("FINANCE_DB", 98441320, 42000000000),
    "ACCOUNT_SUMMARY": ("FINANCE_DB", 6100204, 980000000),
    "EMPLOYEE_RECORDS": ("HR_DB", 48230, 28000000),
    "PRODUCT_CATALOG": ("PRODUCT_DB", 142800, 95000000),
    "PRODUCT_REVIEWS": ("PRODUCT_DB", 2341000, 410000000),
}

# (table, column, type, nullable, nulls, distinct values, samples)
COLUMNS = (
    ("CUSTOMER_MASTER", "CUSTOMER_ID", "INTEGER", False, 0, 4823901, ("10001", "10002", "10003",)),
    ("CUSTOMER_MASTER", "FIRST_NAME", "VARCHAR(50)", False, 0, 312000, ("John", "Jane", "Robert",)),
    ("CUSTOMER_MASTER", "LAST_NAME", "VARCHAR(50)", False, 0, 480000, ("Smith", "Doe", "Johnson",)),
    ("CUSTOMER_MASTER", "EMAIL_ADDRESS", "VARCHAR(120)", True, 92400, 4710000, ("john.smith@email.com",)),
    ("CUSTOMER_MASTER", "PHONE_NUMBER", "VARCHAR(20)", True, 320000, 4400000, ("415-555-0192", "800-555-0199",)),
    ("CUSTOMER_MASTER", "SSN", "CHAR(11)", True, 200000, 4600000, ("123-45-6789", "987-65-4321",)),
    ("CUSTOMER_MASTER", "DATE_OF_BIRTH", "DATE", True, 50000, 25000, ("1985-03-14", "1990-07-22",)),
    ("CUSTOMER_MASTER", "ADDRESS_LINE1", "VARCHAR(200)", True, 100000, 4700000, ("123 Main St", "456 Oak Ave",)),
    ("CUSTOMER_MASTER", "CITY", "VARCHAR(80)", True, 100000, 8000, ("San Francisco", "New York",)),
    ("CUSTOMER_MASTER", "STATE_CODE", "CHAR(2)", True, 100000, 52, ("CA", "NY", "TX",)),
    ("CUSTOMER_MASTER", "ZIP_CODE", "VARCHAR(10)", True, 110000, 42000, ("94105", "10001",)),
    ("CUSTOMER_MASTER", "ACCOUNT_BALANCE", "DECIMAL(18,2)", True, 5000, 3800000, ("1250.00", "87432.50",)),
    ("CUSTOMER_MASTER", "CUSTOMER_SEGMENT", "VARCHAR(30)", True, 10000, 5, ("PREMIUM", "STANDARD",)),
    ("CUSTOMER_MASTER", "CREATED_DATE", "TIMESTAMP", False, 0, 4823901, ("2021-01-15 09:23:11",)),
    ("CUSTOMER_MASTER", "LAST_UPDATED", "TIMESTAMP", False, 0, 4823000, ("2024-11-02 14:55:00",)),
    ("CUSTOMER_MASTER", "IS_ACTIVE", "BYTEINT", False, 0, 2, ("1", "0",)),
    ("PAYMENT_TRANSACTIONS", "TRANSACTION_ID", "BIGINT", False, 0, 98441320, ("TXN-00000001",)),
    ("PAYMENT_TRANSACTIONS", "CUSTOMER_ID", "INTEGER", False, 0, 4800000, ("10001", "10002",)),
    ("PAYMENT_TRANSACTIONS", "TRANSACTION_DATE", "TIMESTAMP", False, 0, 98000000, ("2024-11-01 10:23:00",)),
    ("PAYMENT_TRANSACTIONS", "TRANSACTION_AMOUNT", "DECIMAL(18,2)", False, 0, 5000000, ("99.99", "1500.00",)),
    ("PAYMENT_TRANSACTIONS", "CURRENCY_CODE", "CHAR(3)", False, 0, 32, ("USD", "EUR", "GBP",)),
    ("PAYMENT_TRANSACTIONS", "MERCHANT_NAME", "VARCHAR(200)", True, 200000, 800000, ("AMAZON", "WALMART",)),
    ("PAYMENT_TRANSACTIONS", "CARD_NUMBER", "VARCHAR(19)", True, 50000000, 10000000, ("4532-1234-5678-9010",)),
    ("PAYMENT_TRANSACTIONS", "CARD_TYPE", "VARCHAR(20)", True, 50000000, 5, ("VISA", "MASTERCARD",)),
    ("PAYMENT_TRANSACTIONS", "STATUS", "VARCHAR(20)", False, 0, 4, ("COMPLETED", "PENDING",)),
    ("PAYMENT_TRANSACTIONS", "FRAUD_SCORE", "DECIMAL(5,4)", True, 5000000, 9000, ("0.0012", "0.9987",)),
    ("PAYMENT_TRANSACTIONS", "IP_ADDRESS", "VARCHAR(45)", True, 2000000, 5000000, ("192.168.1.100", "10.0.0.5",)),
    ("PAYMENT_TRANSACTIONS", "CHANNEL", "VARCHAR(20)", False, 0, 6, ("WEB", "MOBILE", "ATM",)),
    ("ACCOUNT_SUMMARY", "ACCOUNT_ID", "BIGINT", False, 0, 6100204, ("ACC-10001",)),
    ("ACCOUNT_SUMMARY", "CUSTOMER_ID", "INTEGER", False, 0, 4800000, ("10001",)),
    ("ACCOUNT_SUMMARY", "SUMMARY_MONTH", "DATE", False, 0, 84, ("2024-11-01",)),
    ("ACCOUNT_SUMMARY", "OPENING_BALANCE", "DECIMAL(18,2)", False, 0, 3000000, ("5000.00",)),
    ("ACCOUNT_SUMMARY", "CLOSING_BALANCE", "DECIMAL(18,2)", False, 0, 3200000, ("5234.50",)),
    ("ACCOUNT_SUMMARY", "TOTAL_CREDITS", "DECIMAL(18,2)", False, 0, 2000000, ("3400.00",)),
    ("ACCOUNT_SUMMARY", "TOTAL_DEBITS", "DECIMAL(18,2)", False, 0, 2000000, ("3165.50",)),
    ("ACCOUNT_SUMMARY", "INTEREST_EARNED", "DECIMAL(10,4)", True, 1000000, 500000, ("12.3400",)),
    ("ACCOUNT_SUMMARY", "ACCOUNT_TYPE", "VARCHAR(30)", False, 0, 4, ("CHECKING", "SAVINGS",)),
    ("EMPLOYEE_RECORDS", "EMPLOYEE_ID", "INTEGER", False, 0, 48230, ("EMP-00101",)),
    ("EMPLOYEE_RECORDS", "FIRST_NAME", "VARCHAR(50)", False, 0, 4000, ("Alice", "Bob",)),
    ("EMPLOYEE_RECORDS", "LAST_NAME", "VARCHAR(50)", False, 0, 12000, ("Wong", "Martinez",)),
    ("EMPLOYEE_RECORDS", "SOCIAL_SECURITY_NUM", "CHAR(11)", False, 0, 48230, ("123-45-6789",)),
    ("EMPLOYEE_RECORDS", "DATE_OF_BIRTH", "DATE", False, 0, 18000, ("1982-06-15",)),
    ("EMPLOYEE_RECORDS", "HIRE_DATE", "DATE", False, 0, 5000, ("2019-03-01",)),
    ("EMPLOYEE_RECORDS", "DEPARTMENT_CODE", "VARCHAR(10)", False, 0, 45, ("FIN", "ENG", "HR",)),
    ("EMPLOYEE_RECORDS", "JOB_TITLE", "VARCHAR(100)", False, 0, 300, ("Senior Engineer",)),
    ("EMPLOYEE_RECORDS", "ANNUAL_SALARY", "DECIMAL(12,2)", False, 0, 8000, ("95000.00", "145000.00",)),
    ("EMPLOYEE_RECORDS", "MANAGER_ID", "INTEGER", True, 500, 2000, ("EMP-00010",)),
    ("EMPLOYEE_RECORDS", "WORK_EMAIL", "VARCHAR(120)", False, 0, 48230, ("alice.wong@company.com",)),
    ("EMPLOYEE_RECORDS", "EMPLOYMENT_STATUS", "VARCHAR(20)", False, 0, 3, ("ACTIVE", "TERMINATED",)),
    ("EMPLOYEE_RECORDS", "PASSWORD_HASH", "VARCHAR(128)", True, 10000, 38000, ("$2b$12$abc...",)),
    ("PRODUCT_CATALOG", "PRODUCT_ID", "INTEGER", False, 0, 142800, ("PRD-1001",)),
    ("PRODUCT_CATALOG", "PRODUCT_NAME", "VARCHAR(200)", False, 0, 142800, ("Widget Pro", "DataKit",)),
    ("PRODUCT_CATALOG", "PRODUCT_CODE", "VARCHAR(20)", False, 0, 142800, ("WGT-PRO-001",)),
    ("PRODUCT_CATALOG", "CATEGORY_NAME", "VARCHAR(80)", False, 0, 120, ("Electronics", "Software",)),
    ("PRODUCT_CATALOG", "UNIT_PRICE", "DECIMAL(10,2)", False, 0, 9000, ("29.99", "199.00",)),
    ("PRODUCT_CATALOG", "COST_PRICE", "DECIMAL(10,2)", False, 0, 8000, ("14.50", "102.00",)),
    ("PRODUCT_CATALOG", "STOCK_QUANTITY", "INTEGER", False, 0, 2000, ("500", "12",)),
    ("PRODUCT_CATALOG", "IS_ACTIVE", "BYTEINT", False, 0, 2, ("1", "0",)),
    ("PRODUCT_CATALOG", "CREATED_DATE", "TIMESTAMP", False, 0, 142800, ("2022-01-10 08:00:00",)),
    ("PRODUCT_CATALOG", "SUPPLIER_ID", "INTEGER", True, 2000, 800, ("SUP-001",)),
    ("PRODUCT_REVIEWS", "REVIEW_ID", "BIGINT", False, 0, 2341000, ("REV-000001",)),
    ("PRODUCT_REVIEWS", "PRODUCT_ID", "INTEGER", False, 0, 142800, ("PRD-1001",)),
    ("PRODUCT_REVIEWS", "CUSTOMER_ID", "INTEGER", False, 0, 1200000, ("10001",)),
    ("PRODUCT_REVIEWS", "RATING", "BYTEINT", False, 0, 5, ("4", "5", "3",)),
    ("PRODUCT_REVIEWS", "REVIEW_TEXT", "VARCHAR(4000)", True, 800000, 1400000, ("Great product!",)),
    ("PRODUCT_REVIEWS", "REVIEW_DATE", "TIMESTAMP", False, 0, 2341000, ("2024-10-15 14:22:00",)),
    ("PRODUCT_REVIEWS", "IS_VERIFIED", "BYTEINT", False, 0, 2, ("1", "0",)),
    ("PRODUCT_REVIEWS", "HELPFUL_VOTES", "INTEGER", False, 0, 800, ("0", "12", "3",)),
)
