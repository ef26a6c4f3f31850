"""Training-data operators: extraction, chat formatting, de-duplication, search, packing, filters and scores."""
