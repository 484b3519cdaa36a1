"""DataFrame operators: parsing, validation, graph tables, search, linking, answers, chat."""
