"""assayist: a record-verification engine expressed as Spark DataFrame plans."""
