"""quillframe: Spark-native analytics for labelled corpora and model evaluation."""
