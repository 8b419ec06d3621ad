"""graphloom: graph analytics and corpus preparation as Spark plans."""
