"""Literature-record processing as DataFrame plans: normalisation, resolution, gates, expansion, audit and export."""
