"""Reading tables and keeping reports."""
