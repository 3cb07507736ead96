"""Operations for large training-data pipelines, each one a DataFrame in, DataFrame out."""
