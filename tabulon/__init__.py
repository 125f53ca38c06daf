"""tabulon: a keyed-table SQL engine whose statements compile to Spark DataFrame plans."""
