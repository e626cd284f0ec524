"""Declared schemas. Nothing is inferred on read."""

from pyspark.sql import types as T

ADDRESS = "struct<street:string,city:string,postcode:string,country:string>"
BANK = ("struct<account_name:string,account_number:string,sort_code:string,iban:string,"
        "swift:string>")
CONTRACTOR = (
    f"struct<name:string,address:{ADDRESS},email:string,phone:string,utr:string,"
    f"ni_number:string,vat_number:string,company_number:string,bank_details:{BANK}>"
)
PERIOD = "struct<start_date:date,end_date:date>"
WORK_ITEM = (
    "struct<property_address:string,plot_number:string,description:string,"
    "quantity:decimal(24,6),unit_price:decimal(24,6),amount:decimal(24,6),"
    "operative_names:array<string>>"
)
FINANCIALS = (
    "struct<subtotal:decimal(24,6),vat_amount:decimal(24,6),vat_code:string,"
    "vat_rate:decimal(24,6),cis_deduction:decimal(24,6),cis_code:string,"
    "total_due:decimal(24,6),currency:string>"
)

ATTEMPTS = (
    "doc_id bigint, attempt_no int, method string, success boolean, confidence double, "
    "error_message string, processing_time_ms bigint"
)
OUTCOMES = "service string, ts timestamp, event_id bigint, ok boolean"
ERRORS = "error_id bigint, ts timestamp, error_type string, message string"
DLQ_EVENTS = (
    "id string, operation_type string, ts timestamp, event_no bigint, action string, "
    "error string, priority int, max_retries int, tags array<string>, payload string"
)
TASKS = ("task_id string, task_type string, started_at timestamp, ended_at timestamp, "
         "status string")
CONVERSATION_EVENTS = "user_id bigint, chat_id bigint, ts timestamp, event string, state string"
SESSION_VERSIONS = (
    "session_id string, version int, layer string, readable boolean, body string, "
    "updated_at timestamp"
)
MODEL_CALLS = (
    "call_id bigint, ts timestamp, model string, tier string, priority int, ok boolean, "
    "latency_ms double, tokens bigint, cost decimal(18,6), error string"
)
MODEL_JSON = (
    "contractor_name string, contractor_email string, contractor_address string, "
    "contractor_utr string, contractor_ni string, bank_account string, sort_code string, "
    "invoice_number string, invoice_date string, work_start_date string, work_end_date string, "
    "subtotal string, vat_amount string, cis_amount string, total string, "
    "customer_name string, customer_email string, currency string, "
    "items array<struct<description:string,quantity:string,unit_price:string,tax_rate:string>>"
)
EVENT_LOG = ("event string, ts timestamp, user_id bigint, invoice_number string, "
             "processing_time double")


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
