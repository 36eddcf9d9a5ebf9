"""pathloom: path references mined from text documents, as Spark DataFrame operators."""
