"""Operations of a training-data pipeline, each by its own method; nothing else in the library imports them."""
