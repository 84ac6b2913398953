"""Training-data operators: deduplication, tokenisation, filters, search,
classification and mixing over the corpus tables. Nothing outside this
subpackage imports it; ``queries`` holds the registered queries."""
