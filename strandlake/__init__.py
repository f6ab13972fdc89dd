"""strandlake: sequence, structure and text-corpus analytics expressed as Spark DataFrame jobs."""
