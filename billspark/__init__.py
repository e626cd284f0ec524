"""billspark: billing-document extraction, validation and operations analytics on Spark."""
