"""quillmill: manuscript analytics as Spark DataFrame operators."""
