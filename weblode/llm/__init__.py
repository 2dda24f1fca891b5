"""Operations of a training-data pipeline: packing, extraction, chat formats, language, quality, search, dedup,
personal data and mixing.  Nothing else in the library imports this subpackage."""
