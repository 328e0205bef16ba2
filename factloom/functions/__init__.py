"""Part of factloom; see the README for the operator index."""
