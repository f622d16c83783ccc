"""From query documents to DataFrames: parsing, checks, compilation, rules, pages."""
