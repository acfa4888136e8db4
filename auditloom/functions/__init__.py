"""Part of auditloom; see README.md."""
