"""Reading tables and cutting plans."""
