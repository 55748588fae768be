"""factmill: long text into checkable facts, and scores for answers about them, as Spark DataFrame pipelines."""
