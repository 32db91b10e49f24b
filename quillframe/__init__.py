"""Document-layout analytics and text-corpus operators as lazy Spark DataFrame transformations."""
