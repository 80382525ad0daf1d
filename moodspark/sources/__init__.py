"""Tables in and out, stored pages, and keyed table maintenance."""
