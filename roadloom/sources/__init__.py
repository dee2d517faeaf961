"""Tables and the roles that they play."""
