"""Operations analytics as Spark DataFrame operators."""
