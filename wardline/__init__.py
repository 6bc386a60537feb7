"""wardline: access-control analytics and corpus operators expressed as Spark plans."""
