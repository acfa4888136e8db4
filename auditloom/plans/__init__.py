"""Registered queries: name -> (function of session and folder, SQL or None)."""
