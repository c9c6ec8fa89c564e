"""Series analytics on Spark: tables of keyed numeric series and relational operators on them."""
