"""ortholens: gene-group analytics and corpus preparation as Spark jobs."""
