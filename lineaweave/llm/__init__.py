"""Operations of a training-data pipeline (quality, language, near copies,
decontamination, tokenizers, archives).

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames, keeps its intermediate tables in the folder that
``spark.checkpoint.dir`` names and gives each row one defined result, also
for nulls, empty texts, repeated rows and empty tables."""
