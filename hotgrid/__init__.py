"""hotgrid: spatio-temporal event analytics and corpus preparation as plain PySpark."""
