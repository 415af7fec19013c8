"""Set-oriented operators; none imports the subpackage of training-data operators."""
