"""Operations on training text: deduplication, classification, tokenising, packing and search."""
