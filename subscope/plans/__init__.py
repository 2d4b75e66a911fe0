"""Named plans. Every function takes the bound ``Tables`` (and a ``Period``) and
returns a lazy DataFrame."""
