"""Operations of a training-data pipeline over text. Nothing outside this subpackage imports it."""
