"""Operations on training text: deduplication, archives, filters, mixing and tokens."""
