"""corpusloom: Spark jobs over collections of linked text documents."""
