"""Mixed-source SQL analytics on Spark: warehouse-dialect SQL in, Spark plans out."""
