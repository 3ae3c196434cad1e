"""Values of the expression language and the functions on them."""
